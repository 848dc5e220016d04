"""From one commit's snapshot to another's, and what that invalidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.lineage import cut
from causeway.operators import ingest, renames
from causeway.operators.graph import Graph
from causeway.plans import incremental
from causeway.plans.build import build_repository, configuration_identity
from causeway.sources import git
from causeway.sources.snapshot import ensure_snapshot, snapshot_key
from causeway.sources.store import Store


@dataclass
class Update:
    base_commit: str
    target_commit: str
    base_key: str
    target_key: str
    #: the target's graph, equal to that of a cold build
    graph: Graph
    #: frames: changes, changed, touched_edges, invalidated, reused; and global_reasons
    plan: dict
    metrics: dict


def tree_changes(spark: SparkSession, root: str, base: str, target: str) -> DataFrame:
    """(kind, path, old_path, similarity, content_changed) between two commits; renames
    are found by joins over both trees, and only where files came and went are blobs read."""
    trees = [cut(git.tree_entries(spark, root, c).where("type <> 'tree'"), "tree") for c in (base, target)]
    changes = cut(incremental.diff_trees(*trees), "changes")
    if {"added", "deleted"} - {r.kind for r in changes.select("kind").distinct().collect()}:
        return changes.withColumn("similarity", F.when(F.col("kind") == "renamed", 100))
    loose = [t.join(changes.where(F.col("kind") == k).select("path"), "path", "left_semi") for t, k in zip(trees, ("deleted", "added"))]
    contents = cut(git.blobs(loose[0].unionByName(loose[1]), root), "loose")
    return cut(renames.with_similar(changes, *trees, contents), "changes")


def update_repository(
    store: Store, root: str, repository: str, base_ref: str, target_ref: str, merge_base: bool = False, policy: ingest.IngestionPolicy = ingest.IngestionPolicy(), discover_rules: bool = True,
    path_rules: tuple[tuple[str, tuple[str, ...]], ...] = (), analysis: dict | None = None, previous_analysis: dict | None = None, edge_kinds: list[str] | None = None,
) -> Update:
    """Both commits' snapshots, each built only if the store has none, the target's from
    the base's relations; and the plan between them. ``analysis`` names versions (see
    ``incremental.GLOBAL_REASONS``), which are part of a snapshot's identity."""
    spark = store.spark
    target = git.resolve(root, target_ref)["commit"]
    base = git.resolve(root, base_ref)["commit"]
    if merge_base:
        base = git.git(root, "merge-base", base, target).decode().strip()
    changes = tree_changes(spark, root, base, target)
    sides, metrics = [], {}
    for name, commit, versions in (("base", base, previous_analysis or analysis), ("target", target, analysis)):
        chosen = configuration_identity(policy, discover_rules, path_rules, versions)
        work: dict = {}

        def made() -> Graph:
            built = build_repository(spark, root, commit, repository, store.root, policy, None if name == "base" else base, discover_rules, path_rules)  # noqa: B023 - called in this turn
            work.update(built.metrics)  # noqa: B023
            return built.graph

        before = dict(store.stats)
        g, found = ensure_snapshot(store, made, repository, commit, commit, chosen)
        sides.append((g, snapshot_key(repository, commit, commit, chosen)))
        moved = {k: store.stats[k] - before[k] for k in ("artifact_writes", "artifact_reuses")}
        metrics |= {f"{name}_{k}": v for k, v in ({"reused_snapshot": found} | work | moved).items()}
    (old, old_key), (new, new_key) = sides
    changed = cut(incremental.changed_nodes(old, new, changes), "changed")
    plan = incremental.plan(old, new, changed, (previous_analysis or analysis or {}, analysis or {}), edge_kinds) | {"changes": changes}
    plan |= {k: cut(plan[k], k) for k in ("touched_edges", "invalidated")}
    same = (F.col("kind") == "renamed") & (F.col("similarity") == 100)
    counted = incremental.metrics(changes.withColumn("content_changed", ~F.coalesce(same, F.lit(False)))).first().asDict()
    reused_edges = new.edges.join(old.edges.select("id"), "id", "left_semi").count()
    metrics |= counted | {"touched_nodes": changed.count(), "touched_edges": plan["touched_edges"].count(), "invalidated_nodes": plan["invalidated"].count(), "reused_nodes": plan["reused"].count(), "reused_edges": reused_edges}
    return Update(base, target, old_key, new_key, new, plan, metrics)
