"""Versioned JSON requests over a bounded graph: info, slice, explain."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.identity import canonical_json
from causeway.operators import policy
from causeway.operators.graph import Graph, from_document, has_partial_evidence

PROTOCOL_VERSION = "causeway.protocol/1"
# fixed values
DEFAULT_DEPTH, DEFAULT_NODES, MOST_DEPTH, MOST_NODES = 6, 200, 64, 1000
FEATURES = [
    {"name": "causal-explanation", "version": "v1", "status": "stable"},
    {"name": "cross-repository", "version": "v1", "status": "experimental"},
    {"name": "extractor-plugins", "version": "v1", "status": "experimental"},
    {"name": "graph-slice", "version": "v1", "status": "stable"},
    {"name": "store-lifecycle", "version": "v1", "status": "experimental"},
    {"name": "traversal-policy", "version": "v1", "status": "stable"},
]
NAMES = {"edgeKinds": "edge_kinds", "nodeKinds": "node_kinds", "evidenceMethods": "methods", "origins": "origins", "authorities": "authorities", "states": "states", "stopNodeKinds": "stop_node_kinds"}


def info() -> dict:
    return {"protocolVersion": PROTOCOL_VERSION, "operations": ["info", "slice", "explain"], "features": FEATURES, "limits": {"defaultMaxDepth": DEFAULT_DEPTH, "defaultMaxNodes": DEFAULT_NODES, "maxDepth": MOST_DEPTH, "maxNodes": MOST_NODES}}


def negotiate(versions: list[str]) -> str | None:
    return PROTOCOL_VERSION if PROTOCOL_VERSION in versions else None


def bounded_policy(raw: dict | None) -> policy.TraversalPolicy:
    raw = raw or {}
    depth, nodes = raw.get("maxDepth", DEFAULT_DEPTH), raw.get("maxNodes", DEFAULT_NODES)
    if not isinstance(depth, int) or not isinstance(nodes, int) or depth > MOST_DEPTH or nodes > MOST_NODES:
        raise ValueError(f"bounds are integers up to depth {MOST_DEPTH} and {MOST_NODES} nodes")
    return policy.TraversalPolicy(direction=raw.get("direction", "out"), max_depth=depth, max_nodes=nodes, **{ours: tuple(raw[theirs]) for theirs, ours in NAMES.items() if theirs in raw})


def _facts(facts: DataFrame, ids: DataFrame | None = None) -> list[dict]:
    """Bounded nodes or edges (those of ``ids``) by id, with their evidence."""
    names = {"src": "from", "dst": "to", "edge_key": "key"}
    out = []
    for r in (facts if ids is None else facts.join(ids, "id", "left_semi")).orderBy("id").collect():
        fact = {names.get(k, k): v for k, v in r.asDict(recursive=True).items() if v is not None}
        fact["provenance"] = [{k: v for k, v in p.items() if v is not None} for p in fact["provenance"]]
        out.append(fact | ({"metadata": json.loads(r.metadata)} if r.metadata is not None else {}))
    return out


def _slice(g: Graph, start: str, p: policy.TraversalPolicy) -> dict:
    if not g.nodes.where(F.col("id") == start).head(1):
        return {"availability": "unavailable", "reason": "unknown-node", "missing": [start], "partial": True, "truncated": False, "nodes": [], "edges": [], "reasons": []}
    reasons, truncated, partial = policy.traverse(g, start, p)
    rows = reasons.orderBy("depth", "id").collect()  # bounded by MOST_NODES
    return {
        "availability": "available", "start": start, "policy": json.loads(p.serialize()), "truncated": truncated, "partial": partial,
        "nodes": _facts(g.nodes, reasons.select("id")), "edges": _facts(g.edges, reasons.select(F.col("edge_id").alias("id"))),
        "reasons": [{"nodeId": r.id, "depth": r.depth, "parent": r.parent, "edgeId": r.edge_id, "evidence": [m.method for m in r.matched]} for r in rows],
    }


def _explain(g: Graph, a: str, b: str, p: policy.TraversalPolicy) -> dict:
    known = {r.id for r in g.nodes.where(F.col("id").isin(a, b)).select("id").collect()}
    if missing := sorted({a, b} - known):
        return {"availability": "unavailable", "reason": "unknown-node", "missing": missing, "partial": True, "truncated": False, "nodes": [], "hops": []}
    hops = policy.explain(g, a, b, p)
    if hops is None:
        return {"availability": "unavailable", "reason": "no-path", "missing": [], "partial": True, "truncated": False, "nodes": [], "hops": []}
    passed = [a, *(n for _, n in hops)]
    edge_ids = [e for e, _ in hops]
    nodes = {n["id"]: n for n in _facts(g.nodes.where(F.col("id").isin(passed)))}
    taken = g.edges.where(F.col("id").isin(edge_ids))
    edges = {e["id"]: e for e in _facts(taken)}
    matched = {r.id: r.methods for r in taken.select("id", F.transform(p.matching(F.col("provenance")), lambda x: x.method).alias("methods")).collect()}
    return {
        "availability": "available", "from": a, "to": b, "policy": json.loads(p.serialize()), "truncated": False, "partial": has_partial_evidence(g).first().partial, "nodes": [nodes[n] for n in passed],
        "hops": [{"fromNodeId": back, "edgeId": e, "nodeId": n, "edge": edges[e], "evidence": matched[e]} for back, (e, n) in zip(passed, hops)],
    }


def execute(spark: SparkSession, request: Any, graph: Graph | None = None) -> dict:
    """An answer to a request; never raises. The graph is ``graph``, or the
    document in the request."""
    rid = request.get("requestId") if isinstance(request, dict) else None
    head = {"protocolVersion": PROTOCOL_VERSION, **({"requestId": rid} if isinstance(rid, str) else {})}
    try:
        if not isinstance(request, dict):
            raise ValueError("a request is an object")
        op = request.get("operation")
        if op == "info":
            return {**head, "ok": True, "data": info()}
        if request.get("protocolVersion") != PROTOCOL_VERSION:
            return {**head, "ok": False, "error": {"code": "unsupported-protocol", "message": f"this is {PROTOCOL_VERSION}"}}
        if op not in ("slice", "explain"):
            raise ValueError(f"unknown operation {op!r}")
        names = ("start",) if op == "slice" else ("from", "to")
        if any(not isinstance(request.get(n), str) or not request[n] for n in names):
            raise ValueError(f"{' and '.join(names)} must be node ids")
        g = graph or from_document(spark, json.dumps(request.get("graph")))
        p = bounded_policy(request.get("policy"))
        data = _slice(g, request["start"], p) if op == "slice" else _explain(g, request["from"], request["to"], p)
        return {**head, "ok": True, "data": data}
    except Exception as e:  # noqa: BLE001 - the contract is an answer, whatever happens
        return {**head, "ok": False, "error": {"code": "invalid-request", "message": str(e)}}


def serialize(response: dict) -> str:
    return canonical_json(response) + "\n"
