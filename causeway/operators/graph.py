"""The graph: merging facts by identity, validating, comparing, rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causeway.functions.identity import canonical_json, edge_id, node_id, packed, unpacked
from causeway.functions.lineage import cut
from causeway.functions.schema import AUTHORITIES, DIAGNOSTICS, EDGES, EDGE_FACTS, GRAPH_SCHEMA_VERSION, METHODS, NODES, NODE_FACTS, ORIGINS, STATES

ABSENT = "<absent>"
NODE_KEY = ["namespace", "kind", "key"]
EDGE_KEY = ["kind", "src", "dst", "edge_key"]


class GraphConflict(ValueError):
    """One identity with different metadata."""


class InvalidGraph(ValueError):
    """A fact that breaks a rule of the model."""


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and diagnostics. A graph that is not ``merged`` has a row for each fact
    of an edge: searches and evidence policies, which ask whether some record allows a
    step, need no merge of them."""

    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    merged: bool = True


def no_diagnostics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIAGNOSTICS)


def sorted_evidence(col: str) -> Column:
    """Distinct records in the order of their JSON text."""
    tagged = F.array_sort(F.transform(F.array_distinct(col), lambda p: F.struct(F.to_json(p).alias("j"), p.alias("p"))))
    return F.transform(tagged, lambda x: x.p)


def _merged(facts: DataFrame, *by: Column | str) -> DataFrame:
    """One row per value of ``by`` with the union of its evidence and the least and most of
    its metadata (absent counts as a value). Equal evidence of one identity is
    dropped in the tasks that read the facts, before the shuffle."""
    rows = facts.select(*by, "metadata", F.explode("provenance").alias("p"))
    merged = rows.groupBy(*[c for c in rows.columns if c not in ("metadata", "p")])
    return merged.agg(F.first("metadata").alias("metadata"), F.min(F.coalesce("metadata", F.lit(ABSENT))).alias("_lo"), F.max(F.coalesce("metadata", F.lit(ABSENT))).alias("_hi"), F.collect_set("p").alias("provenance")).withColumn("provenance", sorted_evidence("provenance"))


def evidence_of(facts: DataFrame, id_: Column) -> DataFrame:
    """(id, p): each record of evidence of an identity once, without the sorted
    lists that a merge makes."""
    return facts.select(id_.alias("id"), F.explode("provenance").alias("p")).distinct()


def merge_nodes(facts: DataFrame) -> DataFrame:
    """Shuffled by what the id is made of, which is shorter than the id."""
    merged = _merged(facts, *NODE_KEY)
    return merged.select(node_id(*NODE_KEY).alias("id"), *merged.columns)


def merge_edges(facts: DataFrame, ends: bool = True) -> DataFrame:
    """Ids are shuffled in 33 bytes: both ends, from which the edge's id is made again, or
    without ``ends`` the edge's id alone (and no src, dst, edge_key are returned)."""
    if not ends:
        merged = _merged(facts, packed(edge_id(*EDGE_KEY)).alias("id"), "kind")
        return merged.withColumn("id", unpacked("id"))
    merged = _merged(facts, "kind", packed("src").alias("src"), packed("dst").alias("dst"), "edge_key")
    merged = merged.withColumns({"src": unpacked("src"), "dst": unpacked("dst")})
    return merged.select(edge_id(*EDGE_KEY).alias("id"), *merged.columns)


def conflicts(merged: DataFrame) -> DataFrame:
    """Ids of merged facts whose metadata differ."""
    return merged.where("_lo <> _hi").select("id")


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, end, node): edge ends that no node has, each once, also where edges repeat.

    The ends that are lacking are found first, among the distinct ones, and written;
    only edges that have one of them are looked up and told apart.
    """
    sides = F.array(F.struct(F.lit("from").alias("end"), packed("src").alias("node")), F.struct(F.lit("to").alias("end"), packed("dst").alias("node")))
    lost = edges.select(F.explode(sides).alias("e")).select("e.node").distinct().join(nodes.select(packed("id").alias("node")), "node", "left_anti")
    ends = edges.select(packed("id").alias("id"), F.explode(sides).alias("e")).select("id", "e.*")
    found = ends.join(cut(lost, "lost").withColumnRenamed("node", "lost"), F.col("node").eqNullSafe(F.col("lost"))).select("id", "end", "node").distinct()
    return found.select(unpacked("id").alias("id"), "end", unpacked("node").alias("node"))


def violation(p: Column) -> Column:
    """The first rule a provenance record breaks, else null."""
    blank = lambda c: c.isNull() | (c == "")
    empty = lambda c: c.isNotNull() & (c == "")
    overlaid = (p.method == "explicit-overlay") & p.overlay.isNotNull() & p.authority.isNotNull()
    return (
        F.when(blank(p.repository), "repository").when(blank(p.ref), "ref").when(empty(p.commit), "commit").when(empty(p.path), "path").when(empty(p.diagnostic), "diagnostic")
        .when(~F.coalesce(p.origin.isin(*ORIGINS), F.lit(False)), "origin").when(~F.coalesce(p.method.isin(*METHODS), F.lit(False)), "method").when(~F.coalesce(p.state.isin(*STATES), F.lit(False)), "state")
        .when(p.authority.isNotNull() & ~p.authority.isin(*AUTHORITIES), "authority")
        .when(p.extractor.isNotNull() & (blank(p.extractor["name"]) | blank(p.extractor["version"])), "extractor").when(p.overlay.isNotNull() & (blank(p.overlay["name"]) | blank(p.overlay["version"])), "overlay")
        .when((p.origin == "overlay") & ~overlaid, "overlay-evidence").when((p.origin != "overlay") & (p.overlay.isNotNull() | p.authority.isNotNull()), "overlay-on-other-origin")
    )


def violations(facts: DataFrame, key: list[str]) -> DataFrame:
    """(identity, rule) of facts that may not enter a graph."""
    identity = F.to_json(F.struct(*key))
    empty = reduce(lambda a, b: a | b, [(F.coalesce(F.col(k), F.lit("")) == "") for k in key if k != "edge_key"])
    bad = F.filter(F.transform("provenance", violation), lambda v: v.isNotNull())
    rule = F.when(empty, "identity").when(F.coalesce(F.size("provenance"), F.lit(0)) < 1, "no-provenance").when(F.size(bad) > 0, bad[0])
    return facts.select(identity.alias("identity"), rule.alias("rule")).where("rule is not null")


def build(node_facts: DataFrame, edge_facts: DataFrame, diagnostics: DataFrame | None = None, *, distinct_diagnostics: bool = False, check: bool = True) -> Graph:
    """Merges facts into a graph.

    Conflicting metadata, invalid facts and dangling edges raise when ``check``
    is on (three small jobs); otherwise they can be listed with the functions
    above. Diagnostics are kept as they are, or once each.
    """
    spark = node_facts.sparkSession
    nodes, edges = merge_nodes(node_facts), merge_edges(edge_facts)
    diagnostics = no_diagnostics(spark) if diagnostics is None else diagnostics
    if check:
        for facts, key in ((node_facts, NODE_KEY), (edge_facts, EDGE_KEY)):
            if bad := violations(facts, key).head(1):
                raise InvalidGraph(f"{bad[0].identity}: {bad[0].rule}")
        if bad := conflicts(nodes).unionByName(conflicts(edges)).head(1):
            raise GraphConflict(f"metadata of {bad[0].id} differ")
        if bad := missing_endpoints(nodes, edges).head(1):
            raise InvalidGraph(f"edge {bad[0].id} has no node {bad[0].node}")
    if distinct_diagnostics:
        diagnostics = diagnostics.withColumn("_j", F.to_json(F.struct(*diagnostics.columns))).dropDuplicates(["_j"]).drop("_j")
    return Graph(nodes.select(*NODES.names), edges.select(*EDGES.names), diagnostics.select(*DIAGNOSTICS.names))


def facts_of(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes.select(*NODE_FACTS.names), g.edges.select(*EDGE_FACTS.names)


def with_edges(g: Graph, facts: DataFrame) -> Graph:
    """A graph of facts with more of them; nothing is merged."""
    if g.merged:
        raise ValueError("a merged graph takes facts by build()")
    more = facts.withColumn("id", edge_id(*EDGE_KEY)).select(*EDGES.names)
    return Graph(g.nodes, g.edges.unionByName(more), g.diagnostics, merged=False)


def union(graphs: list[Graph], **how) -> Graph:
    """All facts of several graphs as one; diagnostics keep their multiplicity."""
    parts = [facts_of(g) for g in graphs]
    nodes, edges, diags = (reduce(DataFrame.unionByName, xs) for xs in ([p[0] for p in parts], [p[1] for p in parts], [g.diagnostics for g in graphs]))
    return build(nodes, edges, diags, **how)


def assemble_fragments(fragments: list[Graph]) -> Graph:
    """As ``union``, with each diagnostic once; ends are checked after the union."""
    return union(fragments, distinct_diagnostics=True)


def equal(a: Graph, b: Graph) -> bool:
    """Same nodes, edges and diagnostics, evidence included."""
    for x, y in ((a.nodes, b.nodes), (a.edges, b.edges), (a.diagnostics, b.diagnostics)):
        rows = [d.select(F.to_json(F.struct(*d.columns)).alias("j")) for d in (x, y)]
        if rows[0].exceptAll(rows[1]).head(1) or rows[1].exceptAll(rows[0]).head(1):
            return False
    return True


def pin(g: Graph, ref: str, commit: str | None, repository_kind: str = "repository") -> Graph:
    """All evidence at ``ref``; the commit only where there was one."""

    def moved(p: Column) -> Column:
        return p.withField("ref", F.lit(ref)).withField("commit", F.when(p.commit.isNotNull(), F.lit(commit)))

    nodes = g.nodes.withColumn("provenance", F.transform("provenance", moved))
    # a repository's metadata is a flat object of strings; keys stay in order
    kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: k != "commit")
    patched = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, F.create_map(F.lit("commit"), F.lit(commit)))))))
    nodes = nodes.withColumn("metadata", F.when((F.col("kind") == repository_kind) & F.col("metadata").isNotNull(), patched).otherwise(F.col("metadata")))
    edges = g.edges.withColumn("provenance", F.transform("provenance", moved))
    return Graph(nodes, edges, g.diagnostics.withColumn("provenance", F.when(F.col("provenance").isNotNull(), moved(F.col("provenance")))))


def totals(g: Graph) -> DataFrame:
    """(what, name, n): nodes and edges by kind, diagnostics by code."""
    return (
        g.nodes.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
        .unionByName(g.edges.groupBy(F.lit("edge").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n")))
        .unionByName(g.diagnostics.groupBy(F.lit("diagnostic").alias("what"), F.col("code").alias("name")).agg(F.count("*").alias("n")))
    )


def has_partial_evidence(g: Graph) -> DataFrame:
    """One row (partial): any diagnostic, or evidence that is not complete."""
    partial = F.exists("provenance", lambda p: p.state != "complete")
    rows = g.nodes.select(partial.alias("x")).unionByName(g.edges.select(partial.alias("x"))).unionByName(g.diagnostics.select(F.lit(True).alias("x")))
    return rows.agg(F.coalesce(F.bool_or("x"), F.lit(False)).alias("partial"))


# --------------------------------------------------------------- documents
def to_document(g: Graph) -> str:
    """Canonical JSON of a graph that fits on the driver (a bounded slice)."""

    def plain(r) -> dict:
        return {k: plain(v) if hasattr(v, "asDict") else v for k, v in r.asDict().items() if v is not None}

    def fact(r, identity: dict) -> dict:
        out = {"id": r.id, "identity": identity, "provenance": [plain(p) for p in r.provenance]}
        return out | ({"metadata": json.loads(r.metadata)} if r.metadata is not None else {})

    nodes = [fact(r, {"namespace": r.namespace, "kind": r.kind, "key": r.key}) for r in g.nodes.orderBy("id").collect()]
    edges = [fact(r, {"kind": r.kind, "from": r.src, "to": r.dst} | ({"key": r.edge_key} if r.edge_key is not None else {})) for r in g.edges.orderBy("id").collect()]
    diags = sorted((plain(r) for r in g.diagnostics.collect()), key=canonical_json)
    return canonical_json({"schemaVersion": GRAPH_SCHEMA_VERSION, "nodes": nodes, "edges": edges, "diagnostics": diags}) + "\n"


def from_document(spark: SparkSession, text: str) -> Graph:
    """A graph from its document; ids are computed again and must agree."""
    doc = json.loads(text)
    if doc.get("schemaVersion") != GRAPH_SCHEMA_VERSION:
        raise InvalidGraph(f"unknown schema version {doc.get('schemaVersion')!r}")
    meta = lambda x: canonical_json(x["metadata"]) if "metadata" in x else None
    prov = lambda x: [{k: p.get(k) for k in NODE_FACTS["provenance"].dataType.elementType.names} for p in x["provenance"]]
    nodes = [(n["identity"]["namespace"], n["identity"]["kind"], n["identity"]["key"], meta(n), prov(n)) for n in doc["nodes"]]
    edges = [(e["identity"]["kind"], e["identity"]["from"], e["identity"]["to"], e["identity"].get("key"), meta(e), prov(e)) for e in doc["edges"]]
    diags = [(d["code"], d["message"], d["state"], prov({"provenance": [d["provenance"]]})[0] if d.get("provenance") else None) for d in doc["diagnostics"]]
    g = build(spark.createDataFrame(nodes, NODE_FACTS), spark.createDataFrame(edges, EDGE_FACTS), spark.createDataFrame(diags, DIAGNOSTICS))
    said = spark.createDataFrame([(x["id"],) for x in doc["nodes"] + doc["edges"]], "id string")
    if said.join(g.nodes.select("id").unionByName(g.edges.select("id")), "id", "left_anti").head(1):
        raise InvalidGraph("an id does not belong to its identity")
    return g


def write(g: Graph, path: str) -> None:
    for name in ("nodes", "edges", "diagnostics"):
        getattr(g, name).write.parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("nodes", NODES), ("edges", EDGES), ("diagnostics", DIAGNOSTICS))))
