"""Schemas of the graph tables and the closed sets of their values."""

from __future__ import annotations

from pyspark.sql import types as T

GRAPH_SCHEMA_VERSION = "causeway.graph/1"

_s = T.StringType()
# fixed values: the fields of a provenance record
_NAMED = T.StructType([T.StructField("name", _s), T.StructField("version", _s)])
PROVENANCE = T.StructType([
    T.StructField("repository", _s), T.StructField("ref", _s), T.StructField("commit", _s), T.StructField("path", _s), T.StructField("extractor", _NAMED),
    T.StructField("origin", _s), T.StructField("method", _s), T.StructField("state", _s), T.StructField("authority", _s), T.StructField("overlay", _NAMED), T.StructField("diagnostic", _s),
])
_EVIDENCE = T.ArrayType(PROVENANCE, False)
#: Facts before they are merged; ``metadata`` is canonical JSON, null when absent.
NODE_FACTS = T.StructType([T.StructField(c, _s) for c in ("namespace", "kind", "key", "metadata")] + [T.StructField("provenance", _EVIDENCE)])
EDGE_FACTS = T.StructType([T.StructField(c, _s) for c in ("kind", "src", "dst", "edge_key", "metadata")] + [T.StructField("provenance", _EVIDENCE)])
NODES = T.StructType([T.StructField("id", _s), *NODE_FACTS.fields])
EDGES = T.StructType([T.StructField("id", _s), *EDGE_FACTS.fields])
DIAGNOSTICS = T.StructType([T.StructField(c, _s) for c in ("code", "message", "state")] + [T.StructField("provenance", PROVENANCE)])

# fixed values
ORIGINS = ("source", "derived", "overlay")
METHODS = ("source-observation", "deterministic-extraction", "external-index", "explicit-overlay")
STATES = ("complete", "partial", "unresolved")
AUTHORITIES = ("authoritative", "advisory")
