"""Graphs over the test tables: supply (tpch), documents and conversations.

Each mapping stands twice, as DataFrames here and as SQL for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from causeway.functions.identity import edge_id, evidence, node_id
from causeway.functions.lineage import cut
from causeway.functions.schema import EDGES, EDGE_FACTS, NODE_FACTS
from causeway.operators.graph import EDGE_KEY, Graph, build

NS = "tpch"
KINDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
_kind = lambda t: "order" if t == "orders" else t


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nid(kind: str, key: Column | str, ns: str = NS) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return node_id(F.lit(ns), F.lit(kind), key.cast("string"))


def _proof(method: Column, state: Column) -> Column:
    origin = F.when(method == "source-observation", "source").otherwise("derived")
    return evidence(repository=NS, ref="refs/heads/main", origin=origin, method=method, state=state)


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = _proof(F.lit("source-observation"), F.lit("complete"))
    frames = [load(spark, sf_dir, t).select(F.lit(NS).alias("namespace"), F.lit(_kind(t)).alias("kind"), F.col(k).cast("string").alias("key"), F.lit(None).cast("string").alias("metadata"), proof.alias("provenance")) for t, k in KINDS.items()]
    return reduce(DataFrame.unionByName, frames)


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src_kind, src_key, dst_kind, dst_key, method, state), one per row of a table;
    equal ones fall together where facts merge."""
    t = {n: load(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    observed, complete = F.lit("source-observation"), F.lit("complete")
    method = F.when(F.col("l_returnflag") == "A", "deterministic-extraction").when(F.col("l_returnflag") == "N", "source-observation").otherwise("external-index")
    state = F.when(F.col("l_linestatus") == "F", "complete").otherwise("partial")

    def link(df: DataFrame, kind: str, a: str, ak: str, b: str, bk: str, m: Column = observed, s: Column = complete) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(a).alias("src_kind"), F.col(ak).cast("string").alias("src_key"), F.lit(b).alias("dst_kind"), F.col(bk).cast("string").alias("dst_key"), m.alias("method"), s.alias("state"))

    frames = [
        link(t["nation"], "belongs-to", "nation", "n_nationkey", "region", "n_regionkey"),
        link(t["customer"], "belongs-to", "customer", "c_custkey", "nation", "c_nationkey"),
        link(t["supplier"], "belongs-to", "supplier", "s_suppkey", "nation", "s_nationkey"),
        link(t["orders"], "placed-by", "order", "o_orderkey", "customer", "o_custkey"),
        link(t["lineitem"], "includes", "order", "l_orderkey", "part", "l_partkey", method, state),
        link(t["lineitem"], "supplied-by", "part", "l_partkey", "supplier", "l_suppkey", method, state),
    ]
    return reduce(DataFrame.unionByName, frames)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = supply_links(spark, sf_dir)
    ends = [node_id(F.lit(NS), f"{e}_kind", f"{e}_key").alias(e) for e in ("src", "dst")]
    none = F.lit(None).cast("string")
    return x.select("kind", *ends, none.alias("edge_key"), none.alias("metadata"), _proof(F.col("method"), F.col("state")).alias("provenance"))


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """The supply graph, assembled. The plan stays open, so that filters and columns
    reach the scans and unused evidence is never gathered."""
    return build(supply_nodes(spark, sf_dir), supply_edges(spark, sf_dir), check=False)


def supply_of_facts(spark: SparkSession, sf_dir: str) -> Graph:
    """The supply graph for searches and policies: a row for each fact of an edge."""
    g = supply(spark, sf_dir)
    edges = supply_edges(spark, sf_dir).withColumn("id", edge_id(*EDGE_KEY)).select(*EDGES.names)
    return Graph(g.nodes, edges, g.diagnostics, merged=False)


# SQL of the same graph: n(id, kind, key), f(kind, src, dst, method, state), e(id, kind, src, dst, records, complete)
def sql_nid(kind: str, key: str, ns: str = NS) -> str:
    return f"""'node:' || sha256('{{"key":"' || ({key})::VARCHAR || '","kind":"' || {kind} || '","namespace":"{ns}"}}')"""


def sql_eid(kind: str, src: str, dst: str) -> str:
    return f"""'edge:' || sha256('{{"from":"' || {src} || '","kind":"' || {kind} || '","to":"' || {dst} || '"}}')"""


_METHOD = "CASE l_returnflag WHEN 'A' THEN 'deterministic-extraction' WHEN 'N' THEN 'source-observation' ELSE 'external-index' END"
_STATE = "CASE l_linestatus WHEN 'F' THEN 'complete' ELSE 'partial' END"


def _sql_links() -> str:
    rows = [
        ("belongs-to", "nation", "n_nationkey", "region", "n_regionkey", "nation"), ("belongs-to", "customer", "c_custkey", "nation", "c_nationkey", "customer"),
        ("belongs-to", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier"), ("placed-by", "order", "o_orderkey", "customer", "o_custkey", "orders"),
        ("includes", "order", "l_orderkey", "part", "l_partkey", "lineitem"), ("supplied-by", "part", "l_partkey", "supplier", "l_suppkey", "lineitem"),
    ]
    parts = []
    for kind, a, ak, b, bk, t in rows:
        m, s = (_METHOD, _STATE) if t == "lineitem" else ("'source-observation'", "'complete'")
        src, dst = sql_nid(f"'{a}'", ak), sql_nid(f"'{b}'", bk)
        parts.append(f"SELECT DISTINCT '{kind}' AS kind, {src} AS src, {dst} AS dst, {m} AS method, {s} AS state FROM {t}")
    return " UNION ALL ".join(parts)


SQL_SUPPLY = f"""
n AS (SELECT {sql_nid('kind', 'key')} AS id, kind, key FROM ({' UNION ALL '.join(f"SELECT '{_kind(t)}' AS kind, {k}::VARCHAR AS key FROM {t}" for t, k in KINDS.items())})),
f AS ({_sql_links()}),
e AS (SELECT {sql_eid('kind', 'src', 'dst')} AS id, kind, src, dst, count(*) AS records, bool_and(state = 'complete') AS complete FROM f GROUP BY kind, src, dst)
"""


# ------------------------------------------------------------------ documents
def document_tree(spark: SparkSession, sf_dir: str, version: str = "B") -> DataFrame:
    """Tree entries (mode, type, sha, path, doc_id) of the two snapshots.

    A has all documents but every tenth; B has all, every seventh moved and
    every eleventh edited.
    """
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    plain = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    if version == "A":
        path, text = plain, F.col("text")
        d = d.where(F.col("doc_id") % 10 != 0)
    else:
        path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("moved/"), plain)).otherwise(plain)
        text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return d.select(F.lit("100644").alias("mode"), F.lit("blob").alias("type"), F.sha2(text, 256).alias("sha"), path.alias("path"), "doc_id")


SQL_TREE = {
    "A": "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 0",
    "B": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text || CASE WHEN doc_id % 11 = 0 THEN ' edited' ELSE '' END) AS sha FROM documents",
}


# -------------------------------------------------------- conversations, events
def _facts(rows: DataFrame, names: list[str], ns: str) -> DataFrame:
    none = F.lit(None).cast("string")
    proof = evidence(repository=ns, ref="refs/heads/main", origin="source", method="source-observation", state="complete")
    extra = [none.alias(c) for c in ("metadata", "edge_key") if c in names and c not in rows.columns]
    return rows.select("*", *extra, proof.alias("provenance")).select(*names)


def conversation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns that reply to the turn before, in one namespace."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    key = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = c.select(F.lit("chat").alias("namespace"), F.lit("turn").alias("kind"), key(F.col("turn")).alias("key"))
    edges = c.where("turn > 0").select(F.lit("replies-to").alias("kind"), nid("turn", key(F.col("turn")), "chat").alias("src"), nid("turn", key(F.col("turn") - 1), "chat").alias("dst"))
    g = build(_facts(nodes, NODE_FACTS.names, "chat"), _facts(edges, EDGE_FACTS.names, "chat"), check=False)
    return Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"), g.diagnostics)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types that follow each other for a user; small and cyclic."""
    e = load(spark, sf_dir, "events")
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = e.select("event_type", after.alias("next")).where("next is not null").distinct()
    nodes = e.select(F.lit("events").alias("namespace"), F.lit("type").alias("kind"), F.col("event_type").alias("key")).distinct()
    edges = pairs.select(F.lit("followed-by").alias("kind"), nid("type", "event_type", "events").alias("src"), nid("type", "next", "events").alias("dst"))
    g = build(_facts(nodes, NODE_FACTS.names, "events"), _facts(edges, EDGE_FACTS.names, "events"), check=False)
    return Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"), g.diagnostics)


SQL_EVENTS = f"""
en AS (SELECT DISTINCT {sql_nid("'type'", 'event_type', 'events')} AS id, event_type AS key FROM events),
ee AS (SELECT DISTINCT {sql_nid("'type'", 'a', 'events')} AS src, {sql_nid("'type'", 'b', 'events')} AS dst FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)
"""
SQL_CHAT = f"""
cn AS (SELECT DISTINCT {sql_nid("'turn'", "conv_id || '/' || turn", 'chat')} AS id, conv_id, turn FROM conversations),
ce AS (SELECT a.id AS src, {sql_nid("'turn'", "a.conv_id || '/' || (a.turn - 1)", 'chat')} AS dst FROM cn a WHERE a.turn > 0)
"""
