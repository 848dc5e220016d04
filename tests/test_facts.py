"""Graphs of facts, packed ids and searches over stored steps."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.functions.identity import is_whole, packed, unpacked
from causeway.operators import graph as G, policy, traverse
from helpers import edges, nid, nodes, proof

m = lambda k: ("module", k)


def facts_graph(spark, node_rows, edge_rows):
    """The graph with a row for each fact of an edge."""
    e = edges(spark, edge_rows)
    g = G.build(nodes(spark, node_rows), e, check=False)
    return G.Graph(g.nodes, e.withColumn("id", G.edge_id(*G.EDGE_KEY)), g.diagnostics, merged=False), g


def test_packed_ids_come_back_in_order(spark):
    texts = [nid("a", k) for k in "abc"] + ["edge:" + "0f" * 32, "node:" + "AB" * 32, "node:" + "0" * 63, "node:" + "0" * 64 + "\n", "", "é", "x\x00y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("p"))
    got = rows.select("t", F.length("p").alias("n"), is_whole(F.col("p")).alias("whole"), unpacked("p").alias("back")).collect()
    assert all(r.t == r.back for r in got) and [r.n for r in got[:4]] == [33] * 4 and [r.whole for r in got] == [False] * 4 + [True] * 6 + [None]
    short = [r.t for r in rows.where(~is_whole(F.col("p"))).orderBy("p").collect()]
    assert short == sorted(texts[:4])


def some_facts(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    out = [(rng.choice(("x", "y")), m(rng.choice(names)), m(rng.choice(names)), None, [proof(state=rng.choice(("complete", "partial")), method=rng.choice(("source-observation", "external-index")))]) for _ in range(60)]
    return [m(k) for k in names[:10]], out  # two ends are lacking


def test_facts_are_searched_as_merged_edges_are(spark):
    a, b = facts_graph(spark, *some_facts(1))
    assert a.edges.count() > b.edges.count()
    start = nid(*m("n0"))
    key = lambda df: sorted(map(str, df.collect()))
    for how in ({}, {"max_depth": 1}, {"max_nodes": 3}):
        x, y = (traverse.affected(g, start, **how) for g in (a, b))
        assert x.truncated == y.truncated and key(x.nodes.select("id", "depth", "parent", "edge_id")) == key(y.nodes.select("id", "depth", "parent", "edge_id"))
    p = policy.TraversalPolicy(direction="both", states=("complete",), methods=("source-observation",), stop_node_kinds=("other",))
    (x, _, px), (y, _, py) = (policy.traverse(g, start, p) for g in (a, b))
    cols = ["id", "depth", "parent", "edge_id", F.to_json("matched").alias("j")]
    assert px == py and key(x.select(*cols)) == key(y.select(*cols)) and x.count() > 1
    assert key(policy.depths(a, start, p)) == key(y.select("id", "depth"))
    far = y.orderBy(F.col("depth").desc(), "id").first().id
    assert policy.explain(a, start, far, p) == policy.explain(b, start, far, p) != []
    assert policy.explain(a, start, far, policy.TraversalPolicy(node_kinds=("other",))) is None
    got = G.missing_endpoints(a.nodes, a.edges)
    assert key(got) == key(G.missing_endpoints(b.nodes, b.edges)) and {r.node for r in got.collect()} <= {nid(*m("n10")), nid(*m("n11"))} and got.count() > 0


def test_stored_steps_are_packed_unless_ids_stand_whole(spark):
    a, _ = facts_graph(spark, *some_facts(3))
    steps = traverse.stored(traverse.steps_of(a, "in"))
    assert dict(steps.dtypes)["at"] == "binary" and "edge_id" not in steps.columns
    odd = traverse.stored(spark.createDataFrame([("a", nid(*m("b")), "e")], "at string, to string, edge_id string"))
    assert [tuple(r) for r in odd.collect()] == [("a", nid(*m("b")), "e")]


def test_merged_edges_without_ends(spark):
    e = edges(spark, some_facts(4)[1])
    whole, short = G.merge_edges(e), G.merge_edges(e, ends=False)
    assert "src" not in short.columns
    both = [sorted((r.id, r.kind, str(r.provenance)) for r in x.collect()) for x in (whole, short)]
    assert both[0] == both[1]
    assert whole.where(F.col("id") != G.edge_id(*G.EDGE_KEY)).isEmpty()


def test_only_what_matches_is_merged(spark):
    e = edges(spark, some_facts(5)[1])
    p = policy.TraversalPolicy(states=("partial",))
    want = {(r.id, len(r.m)) for r in G.merge_edges(e).select("id", p.matching(F.col("provenance")).alias("m")).collect() if r.m}
    assert {(r.id, len(r.provenance)) for r in G.merge_edges(policy.matching_facts(e, p), ends=False).collect()} == want


def test_facts_join_a_graph_of_facts_only(spark):
    a, b = facts_graph(spark, *some_facts(6))
    more = edges(spark, [("z", m("n0"), m("n1"))])
    assert G.with_edges(a, more).edges.where("kind = 'z'").count() == 1
    with pytest.raises(ValueError):
        G.with_edges(b, more)


def test_no_join_with_nodes_goes_down_to_the_steps(spark, monkeypatch):
    """What is written of a level's arrivals reads steps and level only."""
    a, _ = facts_graph(spark, *some_facts(7))
    steps, plans, cut = traverse.stored(traverse.steps_of(a, "in")), [], traverse.cut

    def spy(df, what):
        if what == "near":
            plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return cut(df, what)

    monkeypatch.setattr(traverse, "cut", spy)
    traverse.search(steps, a.nodes.where(F.col("key") == "n0"), 1, enter=traverse.known(a.nodes))
    assert len(plans) == 2 and not any("LeftAnti" in p or "LeftSemi" in p for p in plans)
