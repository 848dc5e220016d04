"""Small graphs as rows."""

from causeway.functions.identity import node_id_of
from causeway.functions.schema import EDGE_FACTS, NODE_FACTS
from causeway.operators.graph import build

NS = "fixture/graph"
_FIELDS = NODE_FACTS["provenance"].dataType.elementType.names


def proof(origin="source", method="source-observation", state="complete", **more):
    p = dict.fromkeys(_FIELDS) | {"repository": "r", "ref": "refs/heads/main", "origin": origin, "method": method, "state": state} | more
    return [p[f] if not isinstance(p[f], dict) else tuple(p[f].values()) for f in _FIELDS]


OVERLAY = {"origin": "overlay", "method": "explicit-overlay", "authority": "authoritative", "overlay": {"name": "o", "version": "1"}}


def nodes(spark, rows):
    """(kind, key[, metadata[, provenance list]])"""
    full = [(NS, r[0], r[1], r[2] if len(r) > 2 else None, [tuple(p) for p in (r[3] if len(r) > 3 else [proof()])]) for r in rows]
    return spark.createDataFrame(full, NODE_FACTS)


def edges(spark, rows):
    """(kind, (kind, key), (kind, key)[, metadata[, provenance list]])"""
    full = [(r[0], nid(*r[1]), nid(*r[2]), None, r[3] if len(r) > 3 else None, [tuple(p) for p in (r[4] if len(r) > 4 else [proof()])]) for r in rows]
    return spark.createDataFrame(full, EDGE_FACTS)


def nid(kind, key):
    return node_id_of(NS, kind, key)


def graph(spark, node_rows, edge_rows, diagnostics=None):
    return build(nodes(spark, node_rows), edges(spark, edge_rows), diagnostics)
