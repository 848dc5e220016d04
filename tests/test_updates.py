"""Updates of a repository, searches with bounds for each seed, and budgets across repositories."""

import random
import re
import subprocess
from collections import deque

import pytest

from causeway import cli
from causeway.functions.lineage import cut
from causeway.functions.paths import glob_regex
from causeway.operators import graph as G, rules, traverse, xrepo
from causeway.operators.ingest import IngestionPolicy
from causeway.plans import incremental
from causeway.plans.build import build_repository, configuration_identity
from causeway.plans.update import update_repository
from causeway.sources.store import Store
from helpers import graph, nid


# ------------------------------------------------------- a bound for each seed
def brute_each(edges, seed, most):
    """A queue; neighbours in the order of (node, edge)."""
    seen, out, queue = {seed}, [], deque([seed])
    while queue:
        at = queue.popleft()
        for to, _ in sorted((t, e) for a, t, e in edges if a == at):
            if to not in seen:
                if len(out) == most:
                    return out
                seen.add(to)
                out.append(to)
                queue.append(to)
    return out


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_each_seed_has_its_own_bound(spark, most):
    rng = random.Random(most)
    edges = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(90)} | {("hub", f"n{k:02}") for k in range(40)})
    edges = [(a, b, f"e{k}") for k, (a, b) in enumerate(edges)]
    steps = spark.createDataFrame(edges, "at string, to string, edge_id string")
    seeds = ["hub", "n00", "n07", "nowhere"]
    got = {(r.seed, r.id) for r in traverse.reach_each(steps, spark.createDataFrame([(x,) for x in seeds], "id string"), max_nodes=most).collect()}
    assert got == {(x, y) for x in seeds for y in brute_each(edges, x, most)}


def test_invalidation_follows_seeds_one_by_one_where_a_bound_binds(spark):
    chain = [("module", f"m{k}") for k in range(9)]
    g = graph(spark, chain, [("uses", chain[k + 1], chain[k]) for k in range(8)])
    changed = spark.createDataFrame([(nid("module", "m0"),), (nid("module", "m5"),)], "id string")
    names = lambda df: sorted(r.key for r in df.join(g.nodes, "id").collect())
    assert names(incremental.invalidated(g, g, changed)) == [f"m{k}" for k in range(9)]
    assert names(incremental.invalidated(g, g, changed, max_nodes=2)) == ["m0", "m1", "m2", "m5", "m6", "m7"]


# ------------------------------------------------------- across repositories
def brute_across(space, resolves, depends, start, hops, most):
    """The queue: resolves (edge, coordinate, package), depends (edge, consumer, coordinate)."""
    nodes, edges, labels, queue, cut = [], set(), {start: 0}, deque([(start, 0)]), False
    while queue:
        at, n = queue.popleft()
        for e, c, p in sorted(resolves):
            if p != at or c not in space:
                continue
            for f, user, d in sorted(depends):
                if d != c or user not in space:
                    continue
                near = n + (space[user] != space[at])
                if near > hops:
                    cut = True
                    continue
                new = [x for x in (c, user) if x not in nodes]
                if len(nodes) + len(new) > most:
                    cut = True
                    continue
                nodes += new
                edges |= {e, f}
                if user not in labels or near < labels[user]:
                    labels[user] = near
                    queue.append((user, near))
    return set(nodes), edges, cut


@pytest.mark.parametrize("seed,hops,most", [(1, 2, 100), (2, 3, 7), (3, 3, 4), (4, 2, 1)])
def test_affected_within_both_bounds(spark, seed, hops, most):
    rng = random.Random(seed)
    space = {f"p{k:02}": f"s{rng.randrange(4)}" for k in range(16)} | {f"c{k:02}": "coordinates" for k in range(16)}
    resolves = [(f"r{k:02}", f"c{k:02}", f"p{rng.choice((k, k, rng.randrange(16))):02}") for k in range(16)]
    depends = [(f"d{k:02}", f"p{rng.randrange(16):02}", f"c{rng.randrange(16):02}") for k in range(34)]
    nodes = spark.createDataFrame([(k, v, "x", k) for k, v in space.items()], "id string, namespace string, kind string, key string")
    rows = [(e, "coordinate-resolves-to", c, p) for e, c, p in resolves] + [(e, "depends-on-coordinate", u, c) for e, u, c in depends]
    g = G.Graph(nodes, spark.createDataFrame(rows, "id string, kind string, src string, dst string"), None)
    got = xrepo.affected_within(g, "p00", hops, most)
    assert ({r.id for r in got.nodes.collect()}, {r.id for r in got.edges.collect()}, got.truncated) == brute_across(space, resolves, depends, "p00", hops, most)
    with pytest.raises(ValueError):
        xrepo.affected_within(g, "p99")


def test_one_snapshot_of_each_repository(spark):
    pins = lambda *x: spark.createDataFrame(list(x), "repository string, ref string, commit string")
    xrepo.one_of_each(pins(("a", "m", "1"), ("b", "m", "1")))
    for bad in ([("a", "m", "1"), ("a", "m", "2")], [("a", "", "1")], [("a", "m", None)]):
        with pytest.raises(ValueError):
            xrepo.one_of_each(pins(*bad))


# ------------------------------------------------------------------- updates
START = {
    "package.json": '{"name":"root"}',
    "src/a.ts": "import { b } from './b'; import './later';\nexport const a = 1, { c, d: [e] } = b;\n",
    "src/b.ts": "export function b() {}\n",
    "src/lone.ts": "export const lone = `${require('./a')}`;\n",
    "src/a.test.ts": "import { a } from './a'\n",
    "lib/x.ts": "export const x = 1\n",
    "lib/y.ts": "import { x } from './x'\n",
    "app/package.json": '{"name":"app","dependencies":{"lib":"workspace:*"},"main":"./main.js"}',
    "CODEOWNERS": "* @all\n/src/** @src\n",
}
EDITS = [
    # a file that an importer waits for, and a manifest that owns what lies below and is depended on
    {"src/later.ts": "export {}\n", "lib/package.json": '{"name":"lib"}'},
    # a moved module, an entry point that appears, a changed name, an edited text
    {"src/b.ts": None, "src/b/index.ts": "export function b() {}\n", "app/main.js": "module.exports = require('../lib/x')\n", "src/lone.ts": "export const alone = 1\n", "lib/package.json": '{"name":"other"}'},
]


def names_of(g):
    known = {r.id: (r.kind, r.key) for r in g.nodes.collect()}
    return {(r.kind, known[r.src], known[r.dst]) for r in g.edges.collect()}


@pytest.fixture
def commits(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for n, files in enumerate([START, *EDITS]):
        for path, text in files.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).unlink() if text is None else (root / path).write_text(text)
        run("add", "-A")
        run("commit", "-qm", str(n))
        run("tag", f"t{n}")
    return str(root)


def test_updates_equal_cold_builds(spark, commits, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    done = update_repository(s, commits, "r", "t0", "t1")
    m = done.metrics
    assert not m["base_reused_snapshot"] and not m["target_reused_snapshot"] and m["base_kept"] == 0
    assert (m["added"], m["deleted"], m["renamed"], m["touched_nodes"]) == (2, 0, 0, 2)
    assert (m["target_parsed"], m["target_resolved"], m["target_kept"]) == (1, 6, 5)  # later, a, the new manifest, two files below it, who depends on it
    lost = {r.key for r in done.plan["invalidated"].join(done.graph.nodes, "id").collect()}
    assert {"src/later.ts", "src/a.ts", "src/a.test.ts", "src/lone.ts"} <= lost and "src/b.ts" not in lost
    again = update_repository(s, commits, "r", "t0", "t1", merge_base=True)
    assert again.metrics["base_reused_snapshot"] and again.metrics["target_reused_snapshot"] and "target_parsed" not in again.metrics
    assert (again.base_key, again.target_key) == (done.base_key, done.target_key)
    ask = lambda *x: cli.run(spark, cli.parser().parse_args([*x, "--root", commits, "--repository", "r", "--store", s.root]))[1]
    told = ask("update", "--base", "t0", "--target", "t1")
    assert told["targetSnapshotKey"] == done.target_key and [(c["kind"], c["path"]) for c in told["changes"]] == [("added", "lib/package.json"), ("added", "src/later.ts")]
    assert ask("snapshot", "--ref", "t1") | {"cache": 0} == {"commit": done.target_commit, "configuration": configuration_identity(), "manifestKey": done.target_key, "reused": True, "cache": 0}
    warm = build_repository(spark, commits, "t2", "r", s.root, base="t1")
    cold = build_repository(spark, commits, "t2", "r")
    assert (warm.metrics["parsed"], warm.metrics["mode"], cold.metrics["kept"]) == (2, "incremental", 0)
    assert 0 < warm.metrics["kept"] and warm.metrics["resolved"] + warm.metrics["kept"] == cold.metrics["resolved"]
    one, other = (G.Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"), cut(g.diagnostics, "said")) for g in (warm.graph, cold.graph))
    assert G.equal(one, other)
    got = names_of(one)
    assert {("imports", ("file", "src/a.ts"), ("file", "src/b/index.ts")), ("imports", ("file", "src/a.ts"), ("file", "src/later.ts"))} <= got
    assert {("package-build-entrypoint", ("package", "app/package.json"), ("file", "app/main.js")), ("path-rule-match", ("path-rule", "CODEOWNERS:1:/src/**"), ("file", "src/a.ts"))} <= got
    assert not any(k == "package-dependency" for k, *_ in got)  # the name is another now


def test_a_changed_version_touches_all(spark):
    g = graph(spark, [("file", "f"), ("module", "m")], [("contains", ("module", "m"), ("file", "f"))])
    done = incremental.plan(g, g, g.nodes.where("false").select("id"), ({"parser": "1"}, {"parser": "2"}))
    assert done["global_reasons"] == ["parser"] and (done["touched_edges"].count(), done["invalidated"].count()) == (1, 2)


def test_rules_by_literals_equal_tests_of_all(spark):
    rng = random.Random(7)
    names = ["a", "b", "src", "x.ts", "y.test.ts", ".env", "m.d.ts", "a.b"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    parts = [*names, "*", "**", "?", "*.ts", "a*", "**.ts", "a**", "*.b*", "**b"]
    globs = sorted({rng.choice(["", "/", "./"]) + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"]) for _ in range(700)} | {"", "/", " src/ "})
    got = rules.match_rules(spark.createDataFrame([(p,) for p in paths], "path string"), list(enumerate(globs)))
    want = {(p, k) for k, g in enumerate(globs) if (r := glob_regex(g)) for p in paths if re.search("(?s)" + r.replace("\\z", "\\Z"), p)}
    rows = got.collect()
    assert len(globs) > rules.FEW and {(r.path, r.ord) for r in rows} == want and len(rows) == len(want)
    last = {p: max(k for q, k in want if q == p) for p, _ in want}
    assert all(r.effective == (r.ord == last[r.path]) for r in rows)


def test_rules_of_a_command():
    a = cli.parser().parse_args(["build-intelligence", "--root", "r", "--repository", "x", "--store", "s", "--rule", "/a=b=@t,@u", "--base", "main"])
    assert [cli._rule(r) for r in a.rule] == [("/a=b", ("@t", "@u"))] and a.base == "main" and a.output is None
    with pytest.raises(ValueError):
        cli._rule("nothing")


def test_configurations_have_identities():
    base = configuration_identity()
    others = [configuration_identity(IngestionPolicy(exclude=("x",))), configuration_identity(discover_rules=False), configuration_identity(path_rules=(("*", ("@a",)),)), configuration_identity(analysis={"parser": "1"})]
    assert len({base, *others}) == 5 and base == configuration_identity() and base.startswith("snapshot-config-sha256-")
