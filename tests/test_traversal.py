import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from causeway.operators import policy, traverse
from helpers import OVERLAY, graph, nid, proof

m = lambda k: ("module", k)


@pytest.fixture(scope="module")
def abc(spark):
    return graph(spark, [m(k) for k in "abcd"], [("depends-on", m("b"), m("a")), ("depends-on", m("c"), m("b")), ("depends-on", m("d"), m("a")), ("documents", m("c"), m("a"))])


def keys(g, found):
    return sorted(r.key for r in found.join(g.nodes, "id").select("key").collect())


def one(g, k):
    return g.nodes.where(F.col("key") == k).select("id")


def test_neighbors(abc):
    assert keys(abc, traverse.neighbors(abc, one(abc, "a"), "in", ["depends-on"])) == ["b", "d"]
    assert keys(abc, traverse.neighbors(abc, one(abc, "c"), "out", ["depends-on"])) == ["b"]


def test_a_loop_gives_the_start(spark):
    g = graph(spark, [m("a")], [("x", m("a"), m("a"))])
    assert keys(g, traverse.neighbors(g, one(g, "a"))) == ["a"]


def test_affected(abc):
    found = traverse.affected(abc, nid("module", "a"), ["depends-on"])
    assert keys(abc, found.nodes) == ["b", "c", "d"] and not found.truncated
    found = traverse.affected(abc, nid("module", "a"), ["depends-on"], max_depth=1)
    assert keys(abc, found.nodes) == ["b", "d"] and found.truncated
    found = traverse.affected(abc, nid("module", "a"), max_nodes=1)
    assert found.nodes.count() == 1 and found.truncated


def test_paths(abc):
    hops = traverse.shortest_path(abc, nid("module", "c"), nid("module", "a"), edge_kinds=["depends-on"])
    assert [n for _, n in hops] == [nid("module", "b"), nid("module", "a")]
    found = traverse.closure(abc, nid("module", "c"), edge_kinds=["depends-on"]).nodes
    assert traverse.path_back(found, nid("module", "c"), nid("module", "a")) == hops and traverse.path_back(found, nid("module", "c"), "node:none") == []
    assert traverse.shortest_path(abc, nid("module", "a"), nid("module", "c"), edge_kinds=["depends-on"]) is None
    assert traverse.shortest_path(abc, nid("module", "a"), nid("module", "a")) == []
    with pytest.raises(ValueError):
        traverse.shortest_path(abc, "node:none", nid("module", "a"))
    with pytest.raises(ValueError):
        traverse.closure(abc, "node:none")


def first_path(edges, start, target, most):
    """What a queue finds first: neighbours in the order of (node, edge)."""
    seen, queue = {start: []}, deque([start])
    while queue:
        at = queue.popleft()
        for to, edge in sorted((t, e) for a, t, e in edges if a == at):
            if to not in seen and len(seen[at]) < most:
                seen[to] = [*seen[at], (edge, to)]
                queue.append(to)
    return seen.get(target)


@pytest.mark.parametrize("seed,most", [(1, 99), (3, 4)])
def test_paths_from_both_ends_are_those_of_a_queue(spark, seed, most):
    rng = random.Random(seed)
    edges = [(f"n{k}_{rng.randrange(4)}", f"n{k + 1 if rng.random() < 0.8 else rng.randrange(9)}_{rng.randrange(4)}", f"e{rng.randrange(10**6)}-{k}-{i}") for k in range(8) for i in range(12)]
    steps = spark.createDataFrame(edges, "at string, to string, edge_id string")
    start = min(a for a, *_ in edges)
    for target in (max(t for _, t, _ in edges), next((t for _, t, _ in edges if t.startswith("n5")), "n5_0"), "nowhere"):
        assert traverse.path_between(steps, start, target, most) == first_path(edges, start, target, most)


def test_long_trails_double(spark):
    pointers = spark.range(60).selectExpr("concat('n', id) as id", "concat('n', id + 1) as to", "concat('e', id) as edge_id")
    for length in (1, 2, 3, 8, 37):
        assert traverse.trail(pointers, "n5", length) == [(f"n{k}", f"e{k}", f"n{k + 1}") for k in range(5, 5 + length)]


def fifo(steps, start, max_depth, max_nodes, closed):
    """The sequential search that the levels must agree with."""
    seen, out, queue, truncated = {start}, {}, deque([(start, 0)]), False
    while queue:
        at, depth = queue.popleft()
        near = sorted(steps.get(at, ()))
        if depth >= max_depth:
            truncated = truncated or any(n not in seen for n, _ in near)
            continue
        for n, e in near:
            if n in seen:
                continue
            if len(out) >= max_nodes:
                return out, True
            seen.add(n)
            out[n] = (depth + 1, at, e)
            if n not in closed:
                queue.append((n, depth + 1))
    return out, truncated


@pytest.mark.parametrize("seed", range(8))
def test_levels_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(2, 12)
    rows = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", f"e{i:03}") for i in range(rng.randint(1, 30))]
    steps: dict = {}
    for a, b, e in rows:
        steps.setdefault(a, []).append((b, e))
    depth, most = rng.choice([0, 1, 2, 64]), rng.choice([1, 3, 100])
    closed = {f"n{rng.randrange(n):02}"} if seed % 2 else set()
    df = spark.createDataFrame(rows, "at string, to string, edge_id string")
    start = spark.createDataFrame([("n00",)], "id string")
    shut = spark.createDataFrame([(c,) for c in closed], "id string") if closed else None
    got = traverse.search(df, start, depth, most, closed=shut)
    want, truncated = fifo(steps, "n00", depth, most, closed)
    assert {r.id: (r.depth, r.parent, r.edge_id) for r in got.nodes.collect()} == want
    assert got.truncated == truncated


@pytest.fixture(scope="module")
def evidence(spark):
    det, ext, over = proof("derived", "deterministic-extraction"), proof("derived", "external-index"), proof(**OVERLAY)
    file, mod, test, cap, owner = ("file", "src/a.ts"), ("module", "module:a"), ("test", "test:a"), ("capability", "payments"), ("owner", "alice")
    return graph(
        spark,
        [(*file, None, [proof()]), (*mod, None, [det]), (*test, None, [det]), (*cap, None, [over]), (*owner, None, [over])],
        [("imports", mod, file, None, [det]), ("tests", test, mod, None, [ext]), ("contains", cap, mod, None, [over]), ("owns", owner, cap, None, [over])],
    )


@pytest.mark.parametrize(
    ("start", "how", "want"),
    [
        (("file", "src/a.ts"), {"methods": ("deterministic-extraction", "explicit-overlay")}, ["alice", "module:a", "payments"]),
        (("file", "src/a.ts"), {"methods": ("deterministic-extraction", "explicit-overlay", "external-index")}, ["alice", "module:a", "payments", "test:a"]),
        (("module", "module:a"), {"authorities": ("authoritative",)}, ["alice", "payments"]),
        (("file", "src/a.ts"), {"methods": ("no-such-method",)}, []),
        (("file", "src/a.ts"), {"node_kinds": ("module", "test")}, ["module:a", "test:a"]),
    ],
)
def test_policy(evidence, start, how, want):
    reasons, truncated, _ = policy.traverse(evidence, nid(*start), policy.TraversalPolicy(direction="in", **how))
    assert keys(evidence, reasons) == want and not truncated
    assert all(r.matched for r in reasons.collect())


def test_stop_kinds_and_bounds(evidence):
    owner = nid("owner", "alice")
    reasons, truncated, _ = policy.traverse(evidence, owner, policy.TraversalPolicy(stop_node_kinds=("capability",)))
    assert keys(evidence, reasons) == ["payments"] and not truncated
    _, truncated, partial = policy.traverse(evidence, owner, policy.TraversalPolicy(max_depth=1))
    assert truncated and partial


def test_explain(evidence):
    p = policy.TraversalPolicy(methods=("explicit-overlay", "deterministic-extraction"))
    hops = policy.explain(evidence, nid("owner", "alice"), nid("file", "src/a.ts"), p)
    kinds = {r.id: r.kind for r in evidence.edges.collect()}
    assert [kinds[e] for e, _ in hops] == ["owns", "contains", "imports"]


def test_policy_text():
    p = policy.TraversalPolicy(edge_kinds=("b", "a", "b"), max_depth=3)
    assert policy.TraversalPolicy.parse(p.serialize()) == p and p.edge_kinds == ("a", "b")
    for bad in ({"direction": "up"}, {"max_depth": -1}, {"max_nodes": 0}, {"methods": ("",)}, {"methods": "x"}):
        with pytest.raises(ValueError):
            policy.TraversalPolicy(**bad)
    with pytest.raises(ValueError):
        policy.TraversalPolicy.parse("{}")
