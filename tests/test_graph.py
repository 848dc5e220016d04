import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from causeway.functions.identity import canonical_json, edge_id, node_id, node_id_of
from causeway.functions.paths import ancestors, glob_regex, matches, parent, resolved
from causeway.operators import graph as G
from helpers import OVERLAY, edges, graph, nid, nodes, proof


def test_golden_id(spark):
    want = "node:fbfa15c7fb215ad0cdf02be75eed9650166b1575b924d72a153ace92e4191511"
    row = spark.range(1).select(node_id(F.lit("github.com/acme/shop"), F.lit("file"), F.lit("src/cart.ts")).alias("id")).first()
    assert row.id == want == node_id_of("github.com/acme/shop", "file", "src/cart.ts")


def test_ids_of_odd_keys(spark):
    keys = ['a"b', "é/ü", "back\\slash", "tab\tnew\nline", "<&>", "日本"]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", node_id(F.lit("n"), F.lit("k"), "key").alias("id")).collect()
    assert all(r.id == node_id_of("n", "k", r.key) for r in rows)


def test_a_null_edge_key_is_left_out(spark):
    import hashlib

    row = spark.range(1).select(edge_id(F.lit("k"), F.lit("a"), F.lit("b")).alias("x"), edge_id(F.lit("k"), F.lit("a"), F.lit("b"), F.lit("q")).alias("y")).first()
    assert row.x == "edge:" + hashlib.sha256(b'{"from":"a","kind":"k","to":"b"}').hexdigest()
    assert row.y == "edge:" + hashlib.sha256(b'{"from":"a","key":"q","kind":"k","to":"b"}').hexdigest()


@pytest.mark.parametrize(
    ("value", "text"),
    [({"10": 1, "2": 2, "b": 3, "a": 4}, '{"2":2,"10":1,"a":4,"b":3}'), ({"x": 1.0}, '{"x":1}'), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (0.1, "0.1"), ([None, True, "é"], '[null,true,"é"]'), (-2.5e-9, "-2.5e-9")],
)
def test_canonical_json(value, text):
    assert canonical_json(value) == text


def test_numbers_must_be_finite():
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8))
def test_canonical_json_keeps_the_value(value):
    assert json.loads(canonical_json(value)) == value


def test_merge_is_a_union_of_evidence(spark):
    a, b = proof(), proof("derived", "deterministic-extraction")
    g = graph(spark, [("file", "cart", None, [b]), ("file", "cart", None, [a, b]), ("file", "cart"), ("file", "money")], [("imports", ("file", "cart"), ("file", "money"), None, [b]), ("imports", ("file", "cart"), ("file", "money"), None, [b, b])])
    assert {r.key: len(r.provenance) for r in g.nodes.collect()} == {"cart": 2, "money": 1}
    assert [len(r.provenance) for r in g.edges.collect()] == [1]


def test_conflicts_and_missing_ends(spark):
    with pytest.raises(G.GraphConflict):
        graph(spark, [("file", "a", "{}"), ("file", "a")], [])
    with pytest.raises(G.InvalidGraph):
        graph(spark, [("file", "a")], [("imports", ("file", "a"), ("file", "b"))])
    with pytest.raises(G.InvalidGraph):
        graph(spark, [("file", "a", None, [])], [])


@pytest.mark.parametrize(
    ("p", "rule"),
    [(proof(ref=""), "ref"), (proof(state="done"), "state"), (proof(origin="x"), "origin"), (proof(authority="advisory"), "overlay-on-other-origin"), (proof(origin="overlay"), "overlay-evidence"), (proof(**OVERLAY), None), (proof(method="explicit-overlay"), None), (proof(commit=""), "commit")],
)
def test_provenance_rules(spark, p, rule):
    found = G.violations(nodes(spark, [("file", "a", None, [p])]), G.NODE_KEY).collect()
    assert [r.rule for r in found] == ([rule] if rule else [])


def test_diagnostics_keep_or_lose_their_copies(spark):
    d = spark.createDataFrame([("c", "m", "partial", None)] * 2, G.DIAGNOSTICS)
    g = graph(spark, [("file", "a")], [], d)
    assert G.union([g, g]).diagnostics.count() == 4
    assert G.assemble_fragments([g, g]).diagnostics.count() == 1


def test_documents_round_trip(spark):
    g = graph(spark, [("file", "a", '{"x":1}'), ("file", "b")], [("imports", ("file", "a"), ("file", "b"), '{"y":[1,2]}')])
    text = G.to_document(g)
    again = G.from_document(spark, text)
    assert G.equal(g, again) and G.to_document(again) == text
    with pytest.raises(G.InvalidGraph):
        G.from_document(spark, text.replace(nid("file", "a")[-8:], "00000000"))
    with pytest.raises(G.InvalidGraph):
        G.from_document(spark, text.replace("causeway.graph/1", "causeway.graph/9"))
    other = graph(spark, [("file", "a", '{"x":2}'), ("file", "b")], [])
    assert not G.equal(g, other)


def test_pin_sets_a_commit_only_where_one_was(spark):
    g = graph(spark, [("file", "a", None, [proof(commit="old")]), ("file", "b")], [])
    got = {r.key: (r.provenance[0].ref, r.provenance[0].commit) for r in G.pin(g, "v1", "new").nodes.collect()}
    assert got == {"a": ("v1", "new"), "b": ("v1", None)}
    g = graph(spark, [("repository", ".", '{"a":"x","commit":"old","z":"y"}'), ("file", "b", '{"commit":"old"}')], [])
    assert {r.key: r.metadata for r in G.pin(g, "v1", "new").nodes.collect()} == {".": '{"a":"x","commit":"new","z":"y"}', "b": '{"commit":"old"}'}


def test_partial_evidence(spark):
    assert not G.has_partial_evidence(graph(spark, [("file", "a")], [])).first().partial
    assert G.has_partial_evidence(graph(spark, [("file", "a", None, [proof(state="partial")])], [])).first().partial


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.ts", "a/b/c.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**/*.ts", "src/b.ts", True), ("src/**", "src/a/b", True), ("/src", "x/src/y", True), ("src/foo", "src/foo/bar", False), ("docs/", "a/docs/b.md", True), ("src/docs/", "src/docs/x/y", True), ("a?c", "x/abc", True), ("", "a", False), ("[ab]", "a", False), ("./src/a", "src/a", True), ("src\\a", "src/a", True), ("a.b", "axb", False), ("src/*.ts", "src/a.ts\n", False)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "path string").select(matches("path", pattern).alias("m")).first().m is hit


def test_empty_glob_has_no_regex():
    assert glob_regex("  ") is None and glob_regex("/") is None


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.ts", "../x/./y"), ("c.ts", "../up"), ("a/b.ts", "https://x/y")], "path string, target string")
    rows = df.select(parent("path").alias("p"), ancestors("path").alias("a"), resolved(parent("path"), F.col("target")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("a/b", ["a", "a/b"], "a/x/y"), ("", [], None), ("a", ["a"], None)]


def test_edges_of_all_kinds_are_counted(spark):
    g = graph(spark, [("m", "a"), ("m", "b")], [("x", ("m", "a"), ("m", "b")), ("y", ("m", "b"), ("m", "a"))])
    assert {(r.what, r.name): r.n for r in G.totals(g).collect()} == {("node", "m"): 2, ("edge", "x"): 1, ("edge", "y"): 1}
    assert edges(spark, []).count() == 0


def test_scopes_belong_to_their_thread(spark):
    """What one thread cuts is not in the scope that another has open."""
    import threading

    from causeway.functions.lineage import place, recorded

    barrier, seen = threading.Barrier(2), {}

    def work(name):
        with recorded() as outer:
            barrier.wait()
            with recorded() as inner:
                seen[name, "inner"] = (place(spark, name), inner)
                barrier.wait()
            seen[name, "outer"] = (place(spark, name), outer)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 4 and all(own == [path] for path, own in seen.values())
