"""Snapshots: a graph's facts as artifacts of a store, under one manifest.

Every node, edge and diagnostic is an artifact, addressed by its content, so a
later snapshot writes only what changed; the manifest's references are the
snapshot. All of it stays in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causeway.functions.identity import keyed_hash
from causeway.functions.lineage import cut
from causeway.functions.schema import DIAGNOSTICS, EDGES, NODES
from causeway.operators.graph import Graph
from causeway.sources.store import Store

TABLES = {"node": NODES, "edge": EDGES, "diagnostic": DIAGNOSTICS}


def snapshot_key(repository: str, ref: str, commit: str, configuration: str | None = None) -> str:
    return keyed_hash("snapshot-sha256-", {"repository": repository, "ref": ref, "commit": commit, "configuration": configuration})


def fact_artifacts(g: Graph) -> DataFrame:
    """(content, kind, payload, times) of all facts; equal diagnostics are counted."""
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*TABLES[kind].names)).alias("payload")) for kind, df in zip(TABLES, (g.nodes, g.edges, g.diagnostics))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.groupBy("kind", "payload").agg(F.count("*").alias("times"))
    return rows.select(F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("content"), "kind", "payload", "times")


def write_snapshot(store: Store, g: Graph, repository: str, ref: str, commit: str, configuration: str | None = None) -> dict[str, int]:
    """Writes what is new and the manifest: {"written": n, "reused": m}."""
    facts = cut(fact_artifacts(g), "facts")
    done = store.put(facts.select("content", "kind", "payload"))
    at = store.keyed(facts).select("key", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("n"))
    store.write_manifest(snapshot_key(repository, ref, commit, configuration), at.select(F.concat_ws("#", "key", F.col("n").cast("string")).alias("logical_key"), "key"), repository, ref, commit, configuration)
    return done


def load_snapshot(store: Store, repository: str, ref: str, commit: str, configuration: str | None = None) -> Graph | None:
    """The snapshot's graph, its payloads verified; None if there is none."""
    refs = store.manifest(snapshot_key(repository, ref, commit, configuration))
    if refs is None:
        return None
    rows = cut(refs.join(store.verified(store.artifacts), "key").select("kind", "payload"), "snapshot")
    nodes, edges, diagnostics = (rows.where(F.col("kind") == kind).select(F.from_json("payload", schema).alias("x")).select("x.*") for kind, schema in TABLES.items())
    return Graph(nodes, edges, diagnostics)


def ensure_snapshot(store: Store, make, repository: str, ref: str, commit: str, configuration: str | None = None) -> tuple[Graph, bool]:
    """(graph, reused): the stored snapshot, or that of ``make()``, written now."""
    if (found := load_snapshot(store, repository, ref, commit, configuration)) is not None:
        return found, True
    write_snapshot(store, make(), repository, ref, commit, configuration)
    return load_snapshot(store, repository, ref, commit, configuration), False
