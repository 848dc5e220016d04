"""Overlays: nodes, edges and path edges that a consumer declares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from causeway.functions.identity import edge_id, evidence, node_id
from causeway.functions.paths import glob_regex
from causeway.functions.schema import EDGE_FACTS, NODE_FACTS
from causeway.operators.graph import Graph, build, facts_of


@dataclass(frozen=True)
class Overlay:
    """``nodes``: namespace, kind, key, metadata, ord. ``edges``: kind, src, dst,
    edge_key, metadata, ord (src and dst are node ids). ``path_edges``: a list of
    (anchor node id, pattern, edge kind, node kinds, direction, key prefix, metadata)."""

    name: str
    version: str
    repository: str
    ref: str
    authority: str = "authoritative"
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    path_edges: tuple = ()
    diagnostic: str | None = None

    def proof(self):
        return evidence(
            repository=self.repository, ref=self.ref, origin="overlay", method="explicit-overlay", state="partial" if self.diagnostic else "complete", authority=self.authority,
            overlay=F.struct(F.lit(self.name).alias("name"), F.lit(self.version).alias("version")), diagnostic=self.diagnostic,
        )


def _declared(rows: DataFrame, id_) -> tuple[DataFrame, DataFrame]:
    """(first declaration of each id with ``torn``, duplicate or conflict rows).

    Later rows of an id are duplicates if equal to the first, else conflicts; one
    conflict drops the identity. Absent metadata equals JSON null.
    """
    rows = rows.withColumn("id", id_).withColumn("_m", F.coalesce("metadata", F.lit("null")))
    w = W.partitionBy("id").orderBy("ord")
    rows = rows.withColumn("_first", F.first("_m").over(w)).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("torn", F.max(F.col("_m") != F.col("_first")).over(W.partitionBy("id")))
    again = rows.where("_n > 1").select("id", (F.col("_m") == F.col("_first")).alias("same"))
    return rows.where("_n = 1").drop("_first", "_n"), again


def _of(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """The facts with a declared id. As a semi-join it goes below the merge of the
    graph's facts, so that only those of declared ids are merged."""
    return facts.join(declared.select("id").distinct(), "id", "left_semi")


def apply_overlay(g: Graph, o: Overlay) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node facts, edge facts, diagnostics (code, subject, state)) that the
    overlay adds. Path edges also match the overlay's own nodes."""
    spark = g.nodes.sparkSession
    none_n, none_e = spark.createDataFrame([], NODE_FACTS), spark.createDataFrame([], EDGE_FACTS)
    said = spark.createDataFrame([], "code string, subject string, state string")
    added = none_n
    known = g.nodes.select("id", "kind", "key")
    if o.nodes is not None:
        first, again = _declared(o.nodes, node_id("namespace", "kind", "key"))
        said = said.unionByName(again.select(F.when(F.col("same"), "overlay-duplicate-node").otherwise("overlay-conflicting-node").alias("code"), F.col("id").alias("subject"), F.lit("partial").alias("state")))
        base = _of(g.nodes, first).select("id", F.coalesce("metadata", F.lit("null")).alias("_base"))
        first = first.where("not torn").join(base, "id", "left")
        clash = F.coalesce(F.col("_base") != F.col("_m"), F.lit(False))
        said = said.unionByName(first.where(clash).select(F.lit("overlay-base-node-conflict").alias("code"), F.col("id").alias("subject"), F.lit("partial").alias("state")))
        good = first.where(~clash)
        added = good.withColumn("provenance", o.proof()).select(*NODE_FACTS.names)
        known = known.unionByName(good.select("id", "kind", "key")).dropDuplicates(["id"])
    edges = none_e
    if o.edges is not None:
        first, again = _declared(o.edges, edge_id("kind", "src", "dst", "edge_key"))
        said = said.unionByName(again.select(F.when(F.col("same"), "overlay-duplicate-edge").otherwise("overlay-conflicting-edge").alias("code"), F.col("id").alias("subject"), F.lit("partial").alias("state")))
        first = first.where("not torn")
        ends = _of(known, first.select(F.explode(F.array("src", "dst")).alias("id"))).select(F.col("id").alias("_end"), F.lit(True).alias("_has"))
        first = first.join(ends.withColumnsRenamed({"_end": "src", "_has": "_from"}), "src", "left").join(ends.withColumnsRenamed({"_end": "dst", "_has": "_to"}), "dst", "left")
        lost = F.col("_from").isNull() | F.col("_to").isNull()
        base = _of(g.edges, first).select("id", F.coalesce("metadata", F.lit("null")).alias("_base"))
        base = base if g.merged else base.distinct()
        first = first.withColumn("_lost", lost).join(base, "id", "left")
        clash = ~F.col("_lost") & F.coalesce(F.col("_base") != F.col("_m"), F.lit(False))
        said = said.unionByName(first.where("_lost").select(F.lit("overlay-missing-edge-endpoint").alias("code"), F.col("id").alias("subject"), F.lit("unresolved").alias("state")))
        said = said.unionByName(first.where(clash).select(F.lit("overlay-base-edge-conflict").alias("code"), F.col("id").alias("subject"), F.lit("partial").alias("state")))
        edges = first.where(~F.col("_lost") & ~clash).withColumn("provenance", o.proof()).select(*EDGE_FACTS.names)
    if o.path_edges:
        more, reported = path_edges(known, o)
        edges, said = edges.unionByName(more), said.unionByName(reported)
    return added, edges, said


def path_edges(known: DataFrame, o: Overlay) -> tuple[DataFrame, DataFrame]:
    """Edges between each anchor and the nodes (id, kind, key) its pattern matches.

    The mappings are the consumer's list; each is one test of a projection over
    the nodes, all in one pass.
    """
    spark = known.sparkSession
    anchors = [m[0] for m in o.path_edges]
    present = {r.id for r in known.where(F.col("id").isin(*anchors)).select("id").collect()}
    tests, said = [], []
    for i, (anchor, pattern, kind, node_kinds, direction, prefix, metadata) in enumerate(o.path_edges):
        if anchor not in present:
            said.append(("overlay-path-anchor-missing", anchor, "unresolved"))
            continue
        regex = glob_regex(pattern)
        hit = F.lit(False) if regex is None else F.col("key").rlike("(?s)" + regex)
        kinds = ["file"] if node_kinds is None else node_kinds
        hit = hit & F.col("kind").isin(*kinds) if kinds else hit
        src, dst = (F.lit(anchor), F.col("id")) if (direction or "out") == "out" else (F.col("id"), F.lit(anchor))
        key = F.concat(F.lit(f"{prefix or 'path'}:{pattern}:"), F.col("id"))
        tests.append((i, pattern, F.when(hit, F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), key.alias("edge_key"), F.lit(metadata).cast("string").alias("metadata")))))
    if not tests:
        return spark.createDataFrame([], EDGE_FACTS), spark.createDataFrame(said, "code string, subject string, state string")
    found = known.select(F.explode(F.array_compact(F.array(*[t[2] for t in tests]))).alias("e")).select("e.*")
    used = {r.i for r in found.select("i").distinct().collect()}
    said += [("overlay-path-no-match", pattern, "unresolved") for i, pattern, _ in tests if i not in used]
    return found.withColumn("provenance", o.proof()).select(*EDGE_FACTS.names), spark.createDataFrame(said, "code string, subject string, state string")


def overlaid(g: Graph, o: Overlay) -> Graph:
    """The graph with the overlay; diagnostics carry its evidence."""
    nodes, edges, said = apply_overlay(g, o)
    base_n, base_e = facts_of(g)
    diags = said.select("code", F.concat_ws(": ", F.lit(f"{o.name}@{o.version}"), "code", "subject").alias("message"), "state", o.proof()[0].alias("provenance"))
    return build(base_n.unionByName(nodes), base_e.unionByName(edges), g.diagnostics.unionByName(diags))
