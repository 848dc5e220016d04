import json
import subprocess

import pytest
from pyspark.sql import functions as F

from causeway import cli, protocol, view
from causeway.functions.identity import node_id_of
from causeway.functions.syntax import manifest, scan
from causeway.operators import graph as G, ingest, overlay, plugin, relations, rules, xrepo
from causeway.plans import incremental
from causeway.plans.build import build_repository
from causeway.sources import git
from causeway.streaming import changes
from helpers import NS, OVERLAY, graph, nid, proof

FILES = {
    "package.json": '{"name":"root","main":"./src/a.ts","types":"./src/none.d.ts"}',
    "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@core/*": ["src/core/*"],}}}',
    "src/a.ts": "import { b } from './b';\nimport type { T } from './b';\nimport x from '@core/util'\nimport 'react';\nexport const a = 1;\n// import './no'\n",
    "src/b.ts": "export function b() {}\nexport { b as c };\nimport('./missing')\n",
    "src/core/util.ts": "export default 1; const s = \"import './not'\";\n",
    "src/a.test.ts": "import { a } from './a'\n",
    "packages/core/package.json": '{"name":"@f/core","exports":{".":{"types":"./i.d.ts","import":"./i.js"}}}',
    "packages/core/i.d.ts": "",
    "packages/core/i.js": "",
    "packages/app/package.json": '{"dependencies":{"@f/core":"workspace:*","external":"^1.0.0","gone":"workspace:*"},"devDependencies":{"c":"file:../core"}}',
    "docs/readme.md": "x",
    "assets/x.bin": "\0\1\2",
    "CODEOWNERS": "# who\n* @all\n/src/** @src\nnothing\n/src/core/** @core @x\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "link").symlink_to("src/a.ts")
    run("add", "-A")
    run("commit", "-qm", "one")
    (root / "src/b.ts").rename(root / "src/b2.ts")
    (root / "src/a.ts").write_text(FILES["src/a.ts"].replace("./b'", "./b2'"))
    run("add", "-A")
    run("commit", "-qm", "two")
    return str(root)


def facts(g):
    names = {r.id: r.key for r in g.nodes.collect()}
    return {(r.kind, names[r.src], names[r.dst]) for r in g.edges.collect() if r.kind != "contains"}


def test_build(spark, repo, tmp_path):
    at = str(tmp_path / "store")
    cold = build_repository(spark, repo, "HEAD~1", "repo", at)
    assert cold.metrics["mode"] == "cold" and cold.metrics["reused"] == 0
    got = facts(cold.graph)
    assert {("imports", "src/a.ts", "src/b.ts"), ("imports", "src/a.ts", "src/core/util.ts"), ("imports", "src/a.test.ts", "src/a.ts"), ("tests", "src/a.test.ts", "src/a.ts"), ("exports", "src/b.ts", "src/b.ts#export:c"), ("exports", "src/core/util.ts", "src/core/util.ts#export:default")} <= got
    assert {("package-build-entrypoint", "package.json", "src/a.ts"), ("package-contract", "packages/core/package.json", "packages/core/i.d.ts"), ("package-build-entrypoint", "packages/core/package.json", "packages/core/i.js"), ("package-dependency", "packages/app/package.json", "packages/core/package.json"), ("belongs-to-package", "packages/core/i.js", "packages/core/package.json"), ("belongs-to-package", "src/a.ts", "package.json")} <= got
    codes = {r.code for r in cold.graph.diagnostics.collect()}
    assert codes == {"tsjs-external-module", "tsjs-unresolved-import", "repository-relations-unresolved-workspace-dependency", "repository-relations-unresolved-entrypoint"}
    wanted = {(r.owner, r.key) for r in cold.keys.collect()}
    assert ("src/b.ts", "file:src/missing.ts") in wanted
    assert json.loads(cold.graph.nodes.where("key = 'link'").first().metadata)["target"] == "src/a.ts"
    warm = build_repository(spark, repo, "HEAD", "repo", at)
    fresh = build_repository(spark, repo, "HEAD", "repo")
    assert warm.metrics == {"mode": "incremental", "parsed": 1, "reused": fresh.metrics["parsed"] - 1, "resolved": len(FILES), "kept": 0}
    assert G.equal(warm.graph, fresh.graph)


def test_git_diff(spark, repo):
    d = [(r.kind, r.path, r.old_path) for r in git.changed_paths(spark, repo, "HEAD~1", "HEAD").collect()]
    assert d == [("modified", "src/a.ts", None), ("renamed", "src/b2.ts", "src/b.ts")]
    trees = [git.tree_entries(spark, repo, c).where("type = 'blob'") for c in ("HEAD~1", "HEAD")]
    got = {(r.kind, r.path, r.old_path) for r in incremental.diff_trees(*trees).collect()}
    assert got == set(d)


def test_filters(spark, repo):
    leaves = git.tree_entries(spark, repo, "HEAD~1").where("type <> 'tree'")
    leaves = leaves.join(git.blobs(leaves, repo), "sha")
    decided = ingest.decide(leaves, ingest.IngestionPolicy(exclude=("docs/**",), vendor=("packages/",), exclude_binary=True))
    got = {(r.code, r.path) for r in ingest.ingestion_diagnostics(decided).collect()}
    assert ("path-excluded", "docs/readme.md") in got and ("binary-excluded", "assets/x.bin") in got and ("vendor-excluded", "packages/core/i.js") in got and len(got) == 6
    kinds = {r.path: r.k for r in leaves.select("path", ingest.entry_kind(F.col("mode"), F.col("type")).alias("k")).collect()}
    assert kinds["link"] == "symlink" and kinds["src/a.ts"] == "file"
    big = ingest.decide(leaves, ingest.IngestionPolicy(exclude_binary=True, max_binary_bytes=1)).where("path = 'assets/x.bin'").first()
    assert big.decision == "binary-check-skipped"


def test_tree_listing(spark):
    raw = spark.createDataFrame([("100644 blob ab\tx y.ts\x00040000 tree cd\tdir\x00",)], "value string")
    assert [tuple(r) for r in ingest.parse_tree(raw).collect()] == [("100644", "blob", "ab", "x y.ts"), ("040000", "tree", "cd", "dir")]
    with pytest.raises(Exception, match="malformed"):
        ingest.parse_tree(spark.createDataFrame([("nonsense\x00",)], "value string")).collect()


def test_rules(spark):
    files = spark.createDataFrame([("CODEOWNERS", FILES["CODEOWNERS"])], "path string, text string")
    parsed = rules.parse_rules(files).orderBy("ord").collect()
    assert [(r.ord, r.pattern, r.targets) for r in parsed] == [(0, "*", ["@all"]), (1, "/src/**", ["@src"]), (2, "/src/core/**", ["@core", "@x"])]
    paths = spark.createDataFrame([("src/core/util.ts",), ("docs/x.md",)], "path string")
    got = rules.match_rules(paths, [(r.ord, r.pattern) for r in parsed]).where("effective").collect()
    assert {(r.path, r.pattern) for r in got} == {("src/core/util.ts", "/src/core/**"), ("docs/x.md", "*")}
    tree = spark.createDataFrame([("100644", "blob", "a", "docs/CODEOWNERS"), ("120000", "blob", "b", ".github/CODEOWNERS"), ("100644", "blob", "c", "CODEOWNERS")], "mode string, type string, sha string, path string")
    assert rules.rule_file(tree).first().path == "CODEOWNERS"


def test_scan():
    got = scan("import a = require('x');\nexport * from \"y\"; const q = require('z'); `import('no')`; /* import 'no2' */ export type { P } from './p';\nimport type { T } from './t'; import { U } from './t';")
    assert [(i["relation"], i["specifier"], i["type_only"]) for i in got["imports"]] == [("import", "./t", False), ("import-equals", "x", False), ("reexport", "./p", True), ("reexport", "y", False), ("require", "z", False)]
    assert scan("")["imports"] == []


def test_manifest():
    assert manifest("[")["problem"].startswith("not JSON") and manifest("[]")["problem"] == "not an object"
    got = manifest('{"name":"n","bin":{"b":"./b.js"},"exports":{"types":"./t.d.ts","default":["./d.js"]}}')
    assert [tuple(e.values()) for e in got["entrypoints"]] == [("bin.b", "./b.js", "build-entrypoint"), ("exports.default.0", "./d.js", "build-entrypoint"), ("exports.types", "./t.d.ts", "contract")]


def test_overlay_over_paths(spark):
    g = graph(spark, [("file", p) for p in ("src/payments/api.ts", "src/payments/db.ts", "src/other.ts")], [])
    rows = [("fixture/graph", "capability", "payments", None, 0), ("fixture/graph", "owner", "alice", None, 1)]
    o = overlay.Overlay(
        "c", "1", "r", "main", nodes=spark.createDataFrame(rows, "namespace string, kind string, key string, metadata string, ord int"),
        edges=spark.createDataFrame([("owns", nid("owner", "alice"), nid("capability", "payments"), None, None, 0)], "kind string, src string, dst string, edge_key string, metadata string, ord int"),
        path_edges=((nid("capability", "payments"), "src/payments/**", "contains", None, None, None, None), (nid("capability", "gone"), "**", "contains", None, None, None, None)),
    )
    done = overlay.overlaid(g, o)
    assert (done.nodes.count(), done.edges.count()) == (5, 3)
    assert [r.code for r in done.diagnostics.collect()] == ["overlay-path-anchor-missing"]


def test_hops(spark):
    nodes = spark.createDataFrame([(r, node_id_of(r, "package", r), "package", r, "npm", r, "1") for r in ("shared", "mid", "app", "other")], "repository string, id string, kind string, key string, ecosystem string, name string, version string")
    rows = [("1", "mid", "package", "mid", "package", "npm", "shared", "1", None, None, None), ("2", "app", "package", "app", "package", "npm", "mid", "1", None, None, None), ("3", "app", "package", "app", "package", "npm", "gone", "1", None, None, None)]
    cols = "id c_repository c_kind c_key kind ecosystem name version p_repository p_kind p_key"
    found = xrepo.outcomes(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split())), nodes)
    assert tuple(xrepo.metrics(found).first()) == (3, 2, 1, 0)
    steps, start = xrepo.bridges(found, nodes), nodes.where("key = 'shared'")
    for budget, want, cut_off in ((0, set(), True), (1, {"mid"}, True), (2, {"mid", "app"}, False)):
        got, truncated = xrepo.affected_across(steps, start, budget)
        assert {r.key for r in got.join(nodes, "id").collect()} == want and truncated == cut_off


def test_plugin_declarations():
    d = plugin.Descriptor("p", "1", "s", ("external-index",), ("complete",))
    assert json.loads(d.to_json())["methods"] == ["external-index"]
    for methods in ((), ("explicit-overlay",), ("x",)):
        with pytest.raises(ValueError):
            plugin.Descriptor("p", "1", "s", methods, ("complete",))
    echo = ["python", "-c", "import sys,json; r=json.loads(sys.stdin.readline()); print(json.dumps({'descriptor': %s, 'output': {'nodes': [r['request']['x']]}}))" % repr(json.loads(d.to_json()))]
    assert plugin.external(echo, d)({"x": 1}) == {"nodes": [1]}
    with pytest.raises(ValueError, match="declaration"):
        plugin.external(["python", "-c", "print('{}')"], d)({})
    with pytest.raises(ValueError, match="too long"):  # ended while it still writes
        plugin.external(["python", "-c", "import sys\nwhile True: sys.stdout.write('x' * 9999)"], d, most_bytes=1 << 20)({"x": "y" * (1 << 20)})
    with pytest.raises(TimeoutError):
        plugin.external(["python", "-c", "import time; time.sleep(60)"], d, timeout=0.5)({})
    with pytest.raises(RuntimeError):
        plugin.external(["python", "-c", "import sys; sys.exit(3)"], d)({})


@pytest.mark.parametrize("base, want", [
    ("a/b.js", ["a/b.js", "a/b.ts", "a/b.tsx", "a/b.d.ts"]), ("s.css", ["s.css"]), ("x.y/b", ["x.y/b", "x.y/b.ts", "x.y/b/index.ts", "x.y/b.tsx"]), (".env", [".env", ".env.ts"]),
])
def test_candidates_of_specifiers(spark, base, want):
    got = spark.createDataFrame([(base,)], "b string").select(relations.module_candidates(F.col("b"))).first()[0]
    assert got[: len(want)] == want and len(got) == (19 if want[-1] != want[0] and "." not in base.rsplit("/", 1)[-1][1:] else len(want))


def test_rules_of_overlays(spark):
    r = spark.createDataFrame([(0, "*", ["@a"], None), (1, "/x", ["@b"], "CODEOWNERS")], "ord long, pattern string, targets array<string>, source_path string")
    m = spark.createDataFrame([("x", "file", 0, False), ("x", "file", 1, True)], "path string, path_kind string, ord long, effective boolean")
    nodes, edges = rules.rule_facts(r, m, NS, "main", "c")
    g = G.build(nodes.unionByName(graph(spark, [("file", "x")], []).nodes.drop("id")), edges)
    assert {r.key: (r.provenance[0].origin, r.provenance[0].authority) for r in g.nodes.where("kind = 'path-rule'").collect()} == {"<overlay>:0:*": ("overlay", "advisory"), "CODEOWNERS:1:/x": ("source", None)}
    assert g.edges.where("""metadata = '{"effective":true}'""").count() == 1


def test_composed_graph(spark):
    g = graph(spark, [("package", "a", '{"x":1}')], [])
    node = g.nodes.select(F.lit("ra").alias("repository"), "id", "kind", "key", F.lit("npm").alias("ecosystem"), F.lit("a").alias("name"), F.lit("1").alias("version"))
    m = spark.createDataFrame([("m1", "ra", "package", "a", "package", "npm", "a", "1", None, None, None), ("m2", "rz", "package", "a", "package", "npm", "b", "1", None, None, None)], "id string, c_repository string, c_kind string, c_key string, kind string, ecosystem string, name string, version string, p_repository string, p_kind string, p_key string")
    pins = spark.createDataFrame([("ra", "main", "c1")], "repository string, ref string, commit string")
    out = xrepo.compose([g], xrepo.outcomes(m, node), node, pins, "n", "1")
    assert {r.kind: json.loads(r.metadata) for r in out.edges.collect()} == {"depends-on-coordinate": {"coordinate": {"ecosystem": "npm", "kind": "package", "name": "a", "version": "1"}, "mappingId": "m1"}, "coordinate-resolves-to": {"producerCommit": "c1", "producerRef": "main", "producerRepository": "ra"}}
    assert out.nodes.count() == 2 and [r.code for r in out.diagnostics.collect()] == ["cross-repo-consumer-unresolved"]


def test_protocol(spark):
    g = graph(spark, [("file", "f"), ("module", "m"), ("test", "t"), ("file", "u")], [("contains", ("module", "m"), ("file", "f")), ("tests", ("test", "t"), ("module", "m"))])
    v = {"protocolVersion": protocol.PROTOCOL_VERSION, "requestId": "q"}
    ask = lambda **r: protocol.execute(spark, {**v, **r}, g)
    assert protocol.execute(spark, {"operation": "info"})["data"]["limits"]["maxNodes"] == 1000
    got = ask(operation="slice", start=nid("file", "f"), policy={"direction": "in"})
    assert got["ok"] and sorted(n["key"] for n in got["data"]["nodes"]) == ["m", "t"] and got["requestId"] == "q"
    assert [(e["kind"], e["provenance"][0]["method"]) for e in sorted(got["data"]["edges"], key=lambda e: e["kind"])] == [("contains", "source-observation"), ("tests", "source-observation")]
    assert got["data"]["nodes"][0]["provenance"][0]["state"] == "complete" and {e["to"] for e in got["data"]["edges"]} == {nid("file", "f"), nid("module", "m")}
    assert [f["name"] for f in protocol.info()["features"]] == sorted(f["name"] for f in protocol.FEATURES)
    got = ask(operation="explain", **{"from": nid("test", "t"), "to": nid("file", "f")})
    assert len(got["data"]["hops"]) == 2 and [n["key"] for n in got["data"]["nodes"]] == ["t", "m", "f"]
    assert [(h["fromNodeId"], h["edge"]["to"]) for h in got["data"]["hops"]] == [(nid("test", "t"), nid("module", "m")), (nid("module", "m"), nid("file", "f"))]
    assert ask(operation="slice", start="node:x")["data"]["reason"] == "unknown-node"
    assert ask(operation="explain", **{"from": nid("file", "u"), "to": nid("file", "f")})["data"]["reason"] == "no-path"
    assert ask(operation="slice", start=nid("file", "f"), policy={"maxNodes": 1001})["error"]["code"] == "invalid-request"
    assert protocol.execute(spark, {"operation": "slice", "protocolVersion": "x"})["error"]["code"] == "unsupported-protocol"
    assert protocol.execute(spark, None)["ok"] is False
    assert protocol.negotiate(["a", protocol.PROTOCOL_VERSION]) and protocol.negotiate(["a"]) is None
    whole = protocol.execute(spark, {**v, "operation": "slice", "start": nid("file", "f"), "graph": json.loads(G.to_document(g))})
    assert whole["ok"] and protocol.serialize(whole).endswith("\n")


def test_cli(spark, tmp_path):
    g = graph(spark, [("file", "f"), ("module", "m")], [("contains", ("module", "m"), ("file", "f"))])
    at = str(tmp_path / "g")
    G.write(g, at)
    ask = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    assert ask("version")[0] == 0
    assert ask("affected", "--graph", at, "--from", nid("file", "f"))[1]["nodes"] == [nid("module", "m")]
    assert ask("neighbors", "--graph", at, "--from", nid("module", "m"))[1]["nodes"] == [nid("file", "f")]
    assert len(ask("explain", "--graph", at, "--from", nid("module", "m"), "--to", nid("file", "f"))[1]["path"]) == 1
    assert ask("protocol", "--request", _file(tmp_path, "{"))[0] == 2


def _file(tmp_path, text):
    (tmp_path / "r").write_text(text)
    return str(tmp_path / "r")


def test_evidence_summary(spark):
    g = graph(spark, [("m", "a", None, [proof(), proof(state="partial"), proof(**OVERLAY)])], [])
    r = view.evidence_summary(g.nodes).first()
    assert (r.origins, r.methods, r.states, r.authorities) == (["overlay", "source"], ["explicit-overlay", "source-observation"], ["complete", "partial"], ["authoritative"])


def test_view_model(spark):
    g = graph(spark, [("m", "a", '{"label":"first"}'), ("m", "b"), ("m", "c")], [("uses", ("m", "a"), ("m", "b")), ("uses", ("m", "b"), ("m", "c")), ("uses", ("m", "a"), ("m", "c"))])
    g = G.Graph(g.nodes.where("key <> 'c'"), g.edges, g.diagnostics)
    nodes, edges = view.model(g, nid("m", "a"))
    shown = {r.id: r for r in nodes.collect()}
    assert {(r.label, r.causal, r.reference_only) for r in shown.values()} == {("first", False, False), ("m: b", False, False), (nid("m", "c"), False, True)}
    assert edges.count() == 3 and edges.first().methods == ["source-observation"] and (shown[nid("m", "a")].x, shown[nid("m", "c")].x) == (0, 260)
    way = [(r.id, nid("m", "b")) for r in g.edges.where(F.col("dst") == nid("m", "b")).collect()]
    nodes, edges = view.model(g, nid("m", "a"), way + way)
    assert sorted((r.label, r.causal) for r in nodes.collect()) == [("first", True), ("m: b", True)]
    assert [(r.src, r.dst, r.causal) for r in edges.collect()] == [(nid("m", "a"), nid("m", "b"), True)]


def test_view(spark):
    g = graph(spark, [("m", "a"), ("m", "<b>"), ("m", "c")], [("x", ("m", "a"), ("m", "<b>"))])
    got = {r.id: (r.x, r.y) for r in view.layout(g, nid("m", "a")).collect()}
    assert got == {nid("m", "a"): (0, 0), nid("m", "<b>"): (260, 0), nid("m", "c"): (520, 0)}
    text = view.svg(g, nid("m", "a"))
    assert text == view.svg(g, nid("m", "a")) and "&lt;b&gt;" in text


def test_plan(spark):
    n = [("file", k) for k in "abcd"]
    dep = lambda a, b: ("depends-on", ("file", a), ("file", b))
    base, target = graph(spark, n, [dep("a", "b"), dep("d", "a")]), graph(spark, n, [dep("a", "c"), dep("d", "a")])
    changed = target.nodes.where("key = 'a'").select("id")
    p = incremental.plan(base, target, changed)
    assert p["touched_edges"].count() == 2 and p["reused"].count() == 4 and p["global_reasons"] == []
    assert {r.id for r in p["invalidated"].collect()} == {nid("file", "a"), nid("file", "d")}
    p = incremental.plan(base, target, changed, ({"parser": "1", "chunk": "1"}, {"parser": "2", "chunk": "2"}))
    assert p["global_reasons"] == ["parser", "chunk"] and p["invalidated"].count() == 4


def test_stream_of_changes(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "table")
    put = lambda rows: spark.createDataFrame(rows, changes.CHANGES).coalesce(1).write.mode("append").json(src)
    put([(1, "a", "1", "added"), (2, "b", "1", "added"), (3, "a", "2", "modified")])
    run = lambda: changes.follow(spark.readStream.schema(changes.CHANGES).json(src), at, str(tmp_path / "cp")).awaitTermination(60)
    run()
    assert {(r.path, r.sha) for r in changes.files(spark, at).collect()} == {("a", "2"), ("b", "1")}
    put([(4, "b", None, "deleted"), (5, "c", "9", "added")])
    run()
    assert {(r.path, r.sha) for r in changes.files(spark, at).collect()} == {("a", "2"), ("c", "9")}
    e = spark.createDataFrame([("2026-01-01 00:05:00", "x"), ("2026-01-01 00:50:00", "x"), ("2026-01-01 01:05:00", "y")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.kind, r.n) for r in changes.windowed_counts(e).collect()) == [("x", 2), ("y", 1)]
