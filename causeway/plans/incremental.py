"""From two trees to what must be rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causeway.functions.lineage import cut
from causeway.operators.graph import Graph
from causeway.operators.traverse import MAX_NODES, oriented, reach, reach_each

#: Versions whose change invalidates everything, in the order of report (fixed values).
GLOBAL_REASONS = ("graph-schema", "analysis-schema", "extractor", "parser", "chunk")


def diff_trees(base: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, path, old_path, content_changed) between trees (path, sha, mode).

    A full join by path gives added, deleted, modified and type-changed entries;
    an added and a deleted path of one content, unique on both sides, are a rename.
    """
    a = base.select("path", F.col("sha").alias("a_sha"), F.col("mode").alias("a_mode"))
    b = target.select("path", F.col("sha").alias("b_sha"), F.col("mode").alias("b_mode"))
    type_ = lambda m: F.substring(m, 1, 3)
    both = a.join(b, "path", "full")
    kind = F.when(F.col("a_sha").isNull(), "added").when(F.col("b_sha").isNull(), "deleted").when(type_("a_mode") != type_("b_mode"), "type-changed").when((F.col("a_sha") != F.col("b_sha")) | (F.col("a_mode") != F.col("b_mode")), "modified")
    both = cut(both.withColumn("kind", kind).where("kind is not null"), "diff")
    new = both.where("kind = 'added'").groupBy(F.col("b_sha").alias("sha")).agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")
    old = both.where("kind = 'deleted'").groupBy(F.col("a_sha").alias("sha")).agg(F.min("path").alias("old_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    renamed = cut(new.join(old, "sha").select("path", "old_path"), "renames")
    rest = both.join(renamed.select("path"), "path", "left_anti").join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti")
    changed = F.coalesce(F.col("a_sha"), F.lit("")) != F.coalesce(F.col("b_sha"), F.lit(""))
    out = rest.select("kind", "path", F.lit(None).cast("string").alias("old_path"), changed.alias("content_changed"))
    return out.unionByName(renamed.select(F.lit("renamed").alias("kind"), "path", "old_path", F.lit(False).alias("content_changed")))


def configuration_reasons(base: dict[str, str], target: dict[str, str]) -> list[str]:
    return [r for r in GLOBAL_REASONS if base.get(r) != target.get(r)]


def touched_edges(base: Graph, target: Graph, changed: DataFrame) -> DataFrame:
    """(id): edges out of the changed nodes (id) in either graph, and edges that
    only one graph has."""
    a, b = base.edges.select("id"), target.edges.select("id")
    one_sided = a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))
    out = [g.edges.join(changed.withColumnRenamed("id", "src"), "src", "left_semi").select("id") for g in (base, target)]
    return one_sided.unionByName(out[0]).unionByName(out[1]).distinct()


def invalidated(base: Graph, target: Graph, changed: DataFrame, edge_kinds: list[str] | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """(id): the changed nodes and all that depend on them in either graph, of each
    changed node the first ``max_nodes``.

    The cap of a single node can only bind where all of them together reach more;
    only then are they followed one by one.
    """
    out = changed.select("id")
    for g in (base, target):
        starts = cut(changed.join(g.nodes.select("id"), "id", "left_semi").select("id"), "starts")
        steps = cut(oriented(g, "in", edge_kinds), "steps")
        found = reach(steps, starts).select("id")
        if found.count() + starts.count() > max_nodes:
            found = reach_each(steps, starts, max_nodes=max_nodes).select("id")
        out = out.unionByName(found)
    return out.distinct()


def reused(base: Graph, target: Graph) -> DataFrame:
    """(id) of nodes that both graphs have; a modified file keeps its id."""
    return target.nodes.select("id").join(base.nodes.select("id"), "id", "left_semi")


def metrics(changes: DataFrame) -> DataFrame:
    kinds = ("added", "modified", "deleted", "renamed", "type-changed")
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in kinds], F.count_if((F.col("kind") == "renamed") & ~F.col("content_changed")).alias("rename_only"))


def changed_nodes(base: Graph, target: Graph, changes: DataFrame) -> DataFrame:
    """(id) of the nodes of the changed paths: old ones in the base, new ones in the target."""
    old = changes.where("kind <> 'added'").select(F.coalesce("old_path", "path").alias("key"))
    new = changes.where("kind <> 'deleted'").select(F.col("path").alias("key"))
    sides = [g.nodes.where("kind in ('file', 'symlink', 'submodule')").join(paths.distinct(), "key", "left_semi").select("id") for g, paths in ((base, old), (target, new))]
    return sides[0].unionByName(sides[1]).distinct()


def plan(base: Graph, target: Graph, changed: DataFrame, versions: tuple[dict, dict] = ({}, {}), edge_kinds: list[str] | None = None, max_nodes: int = MAX_NODES) -> dict:
    """Frames of the update: changed, touched_edges, invalidated, reused, and the
    reasons that touch every edge and invalidate every node of the target."""
    reasons = configuration_reasons(*versions)
    if reasons:
        lost, touched = target.nodes.select("id"), base.edges.select("id").unionByName(target.edges.select("id")).distinct()
    else:
        lost, touched = invalidated(base, target, changed, edge_kinds, max_nodes), touched_edges(base, target, changed)
    return {"changed": changed, "touched_edges": touched, "invalidated": lost, "reused": reused(base, target), "global_reasons": reasons}
