"""``python -m causeway.cli``: build a repository's graph and put questions to it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from causeway import __version__, protocol
from causeway.functions.identity import canonical_json
from causeway.operators import graph as G, policy, traverse
from causeway.plans.build import build_repository, configuration_identity
from causeway.plans.update import update_repository
from causeway.sources import git
from causeway.sources.snapshot import ensure_snapshot, snapshot_key
from causeway.sources.store import Store


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="causeway")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("protocol-info")
    p = sub.add_parser("protocol", help="a request from a file or standard input")
    p.add_argument("--request")
    for name, needs_store in (("build", False), ("build-intelligence", True), ("snapshot", True), ("update", True)):
        b = sub.add_parser(name)
        b.add_argument("--root", required=True)
        b.add_argument("--repository", required=True)
        b.add_argument("--store", required=needs_store, help="folder of the store")
        b.add_argument("--output", required=name == "build", help="folder of the graph's tables")
        b.add_argument("--rule", action="append", default=[], metavar="PATTERN=TARGET,...", help="a path rule after the repository's own")
        b.add_argument("--no-discovered-rules", action="store_true")
        if name == "update":
            b.add_argument("--base", required=True)
            b.add_argument("--target", default="HEAD")
            b.add_argument("--merge-base", action="store_true")
            b.add_argument("--edge-kind", action="append", default=[])
        else:
            b.add_argument("--ref", default="HEAD")
        if name == "build-intelligence":
            b.add_argument("--base", help="a ref whose relations the store may have")
    for name in ("neighbors", "affected", "explain", "traverse-policy", "explain-policy"):
        q = sub.add_parser(name)
        q.add_argument("--graph", required=True, help="folder of the graph's tables")
        q.add_argument("--from", dest="start", required=True)
        if name.startswith("explain"):
            q.add_argument("--to", required=True)
        if name.endswith("policy"):
            q.add_argument("--policy", required=True, help="a policy file")
        else:
            q.add_argument("--direction", choices=("in", "out", "both"), default="out")
            q.add_argument("--edge-kind", action="append", default=[])
        q.add_argument("--max-depth", type=_count, default=64)
        q.add_argument("--max-nodes", type=_count, default=10_000)
    return top


def _rule(text: str) -> tuple[str, tuple[str, ...]]:
    pattern, _, targets = text.rpartition("=")
    if not pattern or not targets:
        raise ValueError(f"not a rule: {text!r}")
    return pattern, tuple(targets.split(","))


def _made(spark: SparkSession, a: argparse.Namespace) -> dict:
    how = {"discover_rules": not a.no_discovered_rules, "path_rules": tuple(map(_rule, a.rule))}
    if a.command in ("build", "build-intelligence"):
        made = build_repository(spark, a.root, a.ref, a.repository, a.store, base=getattr(a, "base", None), **how)
        g, out = made.graph, {"commit": made.commit, "metrics": made.metrics}
    elif a.command == "snapshot":
        commit, store = git.resolve(a.root, a.ref)["commit"], Store(spark, a.store)
        chosen = configuration_identity(**how)
        g, found = ensure_snapshot(store, lambda: build_repository(spark, a.root, commit, a.repository, a.store, **how).graph, a.repository, commit, commit, chosen)
        out = {"commit": commit, "configuration": chosen, "manifestKey": snapshot_key(a.repository, commit, commit, chosen), "reused": found, "cache": store.stats}
    else:
        done = update_repository(Store(spark, a.store), a.root, a.repository, a.base, a.target, a.merge_base, edge_kinds=a.edge_kind or None, **how)
        changes = [{"kind": r.kind, "path": r.path, "oldPath": r.old_path} for r in done.plan["changes"].orderBy("path").collect()]
        g, out = done.graph, {"baseCommit": done.base_commit, "targetCommit": done.target_commit, "baseSnapshotKey": done.base_key, "targetSnapshotKey": done.target_key, "globalInvalidationReasons": done.plan["global_reasons"], "changes": changes, "metrics": done.metrics}
    if a.output:
        G.write(g, a.output)
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[int, dict]:
    if a.command == "version":
        return 0, {"version": __version__}
    if a.command == "protocol-info":
        return 0, protocol.info()
    if a.command == "protocol":
        text = open(a.request).read() if a.request else sys.stdin.read()
        try:
            request = json.loads(text)
        except ValueError:
            request = None
        answer = protocol.execute(spark, request)
        return (0 if answer["ok"] else 2), answer
    if a.command in ("build", "build-intelligence", "snapshot", "update"):
        return 0, _made(spark, a)
    g = G.read(spark, a.graph)
    if a.command == "neighbors":
        starts = g.nodes.where(g.nodes.id == a.start)
        rows = traverse.neighbors(g, starts, a.direction, a.edge_kind or None).orderBy("id", "edge_id").collect()
        return 0, {"nodes": sorted({r.id for r in rows}), "edges": sorted({r.edge_id for r in rows})}
    if a.command == "affected":
        found = traverse.closure(g, a.start, "in", a.edge_kind or None, a.max_depth, a.max_nodes)
        rows = found.nodes.orderBy("id").collect()
        return 0, {"truncated": found.truncated, "nodes": [r.id for r in rows], "edges": sorted(r.edge_id for r in rows)}
    if a.command == "traverse-policy":
        reasons, truncated, partial = policy.traverse(g, a.start, policy.TraversalPolicy.parse(open(a.policy).read()))
        return 0, {"truncated": truncated, "partial": partial, "reasons": [{"nodeId": r.id, "depth": r.depth, "edgeId": r.edge_id} for r in reasons.orderBy("depth", "id").collect()]}
    if a.command == "explain-policy":
        path = policy.explain(g, a.start, a.to, policy.TraversalPolicy.parse(open(a.policy).read()))
    else:
        path = traverse.shortest_path(g, a.start, a.to, a.direction, a.edge_kind or None, a.max_depth)
    return 0, {"path": None if path is None else [{"edgeId": e, "nodeId": n} for e, n in path]}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("causeway").getOrCreate()
    try:
        code, out = run(spark, a)
    except Exception as e:  # noqa: BLE001 - errors are JSON on standard error
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 1
    print(canonical_json(out))
    return code


if __name__ == "__main__":
    sys.exit(main())
