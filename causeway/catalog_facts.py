"""More registered queries: candidates, rules, listings, checks, composition, plugins, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causeway import demo_tables as D
from causeway.catalog import _RULES, _XREPO, REGION, REGION_SQL, _packages, _reach_sql, query
from causeway.demo_tables import NS, SQL_EVENTS, SQL_SUPPLY, SQL_TREE, load, sql_eid, sql_nid
from causeway.functions.identity import canonical_metadata, evidence, node_id
from causeway.functions.lineage import cut, shared_dir
from causeway.functions.paths import glob_regex
from causeway.operators import graph as G, ingest, plugin, relations, rules, traverse, xrepo
from causeway.sources import snapshot
from causeway.sources.store import Store

# ------------------------------------------------------------------- candidates
_ENDINGS = ("", ".js", ".jsx", ".mjs", ".cjs", ".css", ".ts")
_INDEXED = [x for e in (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts") for x in (e, "/index" + e)]
_TRIED = [["", *_INDEXED], [".js", ".ts", ".tsx", ".d.ts"], [".jsx", ".tsx", ".ts"], [".mjs", ".mts"], [".cjs", ".cts"], [".css"], [".ts"]]
_CASES = " ".join(f"WHEN {i} THEN [{', '.join(f'stem || {chr(39)}{e}{chr(39)}' for e in own)}]" for i, own in enumerate(_TRIED))


def _stems(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("m.x/m"), F.col("doc_id").cast("string"))).alias("stem"))


@query("import_candidates", f"""WITH b AS (SELECT doc_id, source || '/' || lang || '/m.x/m' || doc_id AS stem FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT doc_id, CASE doc_id % 7 {_CASES} END AS tried FROM b)
SELECT doc_id, unnest(tried) AS candidate, generate_subscripts(tried, 1)::INT - 1 AS pos FROM c""")
def import_candidates(spark, sf):
    """The files that a specifier may stand for, by its ending, in order."""
    b = _stems(spark, sf).where("stem is not null").join(load(spark, sf, "documents").where("source is not null and lang is not null").select("doc_id"), "doc_id", "left_semi")
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return b.select("doc_id", F.posexplode(relations.module_candidates(F.concat("stem", ending))).alias("pos", "candidate"))


_TESTS = (("src/a{}.test.ts", ["src/a{}.ts"]), ("src/__tests__/a{}.spec.jsx", ["src/__tests__/a{}.jsx", "src/a{}.jsx"]), ("__tests__/a{}.test.mts", ["__tests__/a{}.mts", "a{}.mts"]), ("src/__tests__/a{}.ts", []), ("a{}.spec.cjs", ["a{}.cjs"]), ("src/a{}.test.md", []))


def _named(text: str) -> str:
    return "'" + text.replace("{}", "' || doc_id || '") + "'"


def _test_path():
    return F.element_at(F.array(*[F.concat(*[F.lit(x) if k == 0 else F.concat(F.col("doc_id").cast("string"), F.lit(x)) for k, x in enumerate(p.split("{}"))]) for p, _ in _TESTS]), (F.col("doc_id") % len(_TESTS) + 1).cast("int"))


@query("test_sources", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {_named(p)} AS path, {_named(c)} AS source FROM documents WHERE doc_id % {len(_TESTS)} = {i}" for i, (p, own) in enumerate(_TESTS) for c in own) + ")")
def test_sources(spark, sf):
    """What test files may cover; files without a test's mark cover nothing."""
    return load(spark, sf, "documents").select(_test_path().alias("path")).select("path", F.explode(relations.test_candidates(F.col("path"))).alias("source"))


@query("source_and_test_files", f"WITH p AS (SELECT CASE doc_id % {len(_TESTS)} {' '.join(f'WHEN {i} THEN {_named(p)}' for i, (p, _) in enumerate(_TESTS))} END AS path FROM documents) SELECT path, NOT ends_with(path, '.md') AS is_source, NOT ends_with(path, '.md') AND (contains(path, '.test.') OR contains(path, '.spec.')) AS is_test FROM p")
def source_and_test_files(spark, sf):
    p = load(spark, sf, "documents").select(_test_path().alias("path"))
    return p.select("path", relations.is_source(F.col("path")).alias("is_source"), relations.is_test(F.col("path")).alias("is_test"))


# ------------------------------------------------------------- rules, listings
_RULE_KEY = "'CODEOWNERS:' || ord || ':' || pattern"


@query("rule_nodes", "WITH r(ord, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_RULES)) + f""") SELECT {sql_nid("'path-rule'", _RULE_KEY, 'docs')} AS id, {_RULE_KEY} AS key, '{{"order":' || ord || ',"pattern":"' || pattern || '","source":"repository","sourcePath":"CODEOWNERS","targets":["@t' || ord || '"]}}' AS metadata FROM r""")
def rule_nodes(spark, sf):
    """Path rules as nodes."""
    return G.merge_nodes(_rule_facts(spark, sf)[0]).select("id", "key", "metadata")


@query("rule_match_edges", f"WITH t AS ({SQL_TREE['B']}), m AS (" + " UNION ALL ".join(f"SELECT path, {i}::BIGINT AS ord, '{p}' AS pattern FROM t WHERE regexp_matches(path, '{glob_regex(p)}')" for i, p in enumerate(_RULES)) + f"""),
e AS (SELECT {sql_nid("'path-rule'", _RULE_KEY, 'docs')} AS src, {sql_nid("'file'", 'path', 'docs')} AS dst, ord = max(ord) OVER (PARTITION BY path) AS effective FROM m)
SELECT {sql_eid("'path-rule-match'", 'src', 'dst')} AS id, src, dst, '{{"effective":' || effective || '}}' AS metadata FROM e""")
def rule_match_edges(spark, sf):
    """An edge from each rule to each path it matches, the last one effective."""
    return G.merge_edges(_rule_facts(spark, sf)[1]).select("id", "src", "dst", "metadata")


def _rule_facts(spark, sf):
    r = spark.createDataFrame([(i, p, [f"@t{i}"], "CODEOWNERS") for i, p in enumerate(_RULES)], "ord long, pattern string, targets array<string>, source_path string")
    matches = rules.match_rules(D.document_tree(spark, sf).select("path"), list(enumerate(_RULES))).withColumn("path_kind", F.lit("file"))
    return rules.rule_facts(r, matches, "docs", "refs/heads/main")


@query("parsed_rules", """SELECT 'CODEOWNERS' || doc_id AS source_path, 0 AS ord, '/src' || doc_id AS pattern, '@a @b' AS targets FROM documents
UNION ALL SELECT 'CODEOWNERS' || doc_id, 1, '*.js', '@t' || doc_id FROM documents""")
def parsed_rules(spark, sf):
    """Rule files without comments, blank lines and lines that name no target."""
    n = F.col("doc_id").cast("string")
    files = load(spark, sf, "documents").select(F.concat(F.lit("CODEOWNERS"), n).alias("path"), F.concat(F.lit("# owners\r\n\n/src"), n, F.lit(" @a  @b\nlonely\n  *.js\t@t"), n, F.lit("\n")).alias("text"))
    return rules.parse_rules(files).select("source_path", F.col("ord").cast("int").alias("ord"), "pattern", F.concat_ws(" ", "targets").alias("targets"))


@query("tree_listing", "SELECT '100644' AS mode, 'blob' AS type, md5(doc_id::VARCHAR) AS sha, 'a b/' || doc_id || chr(10) || '.txt' AS path FROM documents UNION ALL SELECT '040000', 'tree', md5(doc_id::VARCHAR), 'd' || doc_id FROM documents")
def tree_listing(spark, sf):
    """NUL-separated listings; paths may hold any other character."""
    n = F.col("doc_id").cast("string")
    nul = F.lit("\u0000")
    raw = load(spark, sf, "documents").select(F.concat(F.lit("100644 blob "), F.md5(n), F.lit("\ta b/"), n, F.lit("\n.txt"), nul, F.lit("040000 tree "), F.md5(n), F.lit("\td"), n, nul).alias("value"))
    return ingest.parse_tree(raw)


@query("binary_files", "SELECT doc_id, doc_id % 3 = 0 AND strlen(coalesce(text, '')) < 8192 AS looks_binary FROM documents")
def binary_files(spark, sf):
    """A NUL among the first 8192 bytes makes a file binary."""
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("20"))))
    return load(spark, sf, "documents").select("doc_id", ingest.has_nul(content).alias("looks_binary"))


@query("entry_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'directory' WHEN 1 THEN 'submodule' WHEN 2 THEN 'symlink' ELSE 'file' END AS kind FROM documents")
def entry_kinds(spark, sf):
    n = F.col("doc_id") % 5
    mode = F.when(n == 0, "040000").when(n == 1, "160000").when(n == 2, "120000").when(n == 3, "100755").otherwise("100644")
    type_ = F.when(n == 0, "tree").when(n == 1, "commit").otherwise("blob")
    return load(spark, sf, "documents").select("doc_id", ingest.entry_kind(mode, type_).alias("kind"))


# ---------------------------------------------------------------------- checks
_BROKEN = (None, "repository", "origin", "state", "overlay-evidence", "no-provenance", "identity", "method")


@query("fact_violations", f"SELECT doc_id::VARCHAR AS fact, CASE doc_id % {len(_BROKEN)} " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_BROKEN) if r) + f" END AS rule FROM documents WHERE doc_id % {len(_BROKEN)} <> 0")
def fact_violations(spark, sf):
    """The first rule that each invalid fact breaks."""
    n = F.col("doc_id") % len(_BROKEN)
    pick = lambda k, bad, good: F.when(n == k, bad).otherwise(good)
    proof = evidence(repository=pick(1, "", "r"), ref="main", origin=F.when(n == 2, "guess").when(n == 4, "overlay").otherwise("source"), method=pick(7, "luck", "source-observation"), state=pick(3, "maybe", "complete"))
    facts = load(spark, sf, "documents").select(F.lit("docs").alias("namespace"), F.when(n == 6, "").otherwise("file").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.when(n == 5, F.filter(proof, lambda p: F.lit(False))).otherwise(proof).alias("provenance"))
    return G.violations(facts, G.NODE_KEY).select(F.get_json_object("identity", "$.key").alias("fact"), "rule")


@query("canonical_texts", """SELECT doc_id, '{"1":{"a":null,"é":true},"a":[1,0.5,"x"],"b":' || doc_id || '}' AS canonical FROM documents""")
def canonical_texts(spark, sf):
    """JSON with sorted keys and numbers in one form, without white space."""
    text = F.concat(F.lit('{ "b" : '), F.col("doc_id").cast("string"), F.lit('.0, "a": [1.0, 5e-1, "x"], "1": {"é": true, "a": null}}'))
    return load(spark, sf, "documents").select("doc_id", canonical_metadata(text).alias("canonical"))


@query("closure_of_broken_graph", _reach_sql("SELECT dst AS at, src AS dest FROM e WHERE src NOT IN (SELECT id FROM n WHERE kind = 'customer')", REGION_SQL, 5))
def closure_of_broken_graph(spark, sf):
    """Edges to nodes that the graph doesn't have are not followed."""
    g = D.supply_of_facts(spark, sf)
    nodes = g.nodes.where("kind <> 'customer'")
    found = traverse.reach(traverse.stored(traverse.steps_of(g, "in"), ordered=False), nodes.where(F.col("id") == REGION), enter=traverse.known(nodes))
    return found.join(g.nodes.select("id", "kind"), "id", "left").select("id", "kind", "depth")


@query("merged_graph_equals", f"WITH {SQL_SUPPLY} SELECT kind, count(*) AS facts, true AS same FROM n GROUP BY kind")
def merged_graph_equals(spark, sf):
    """Facts in another order, and twice, merge to the same nodes."""
    facts = D.supply_nodes(spark, sf)
    a = G.merge_nodes(facts).select("id", "kind", F.to_json("provenance").alias("a"))
    b = G.merge_nodes(facts.unionByName(facts).repartition(3, "key")).select("id", F.to_json("provenance").alias("b"))
    return a.join(b, "id", "full").groupBy("kind").agg(F.count("*").alias("facts"), F.bool_and(F.col("a") == F.col("b")).alias("same"))


# ----------------------------------------------------------------- composition
def _composed(spark, sf):
    nodes, m = _packages(spark, sf)
    pins = load(spark, sf, "supplier").select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("repository")).distinct().select("repository", F.lit("refs/heads/main").alias("ref"), F.md5("repository").alias("commit"))
    return xrepo.composed_facts(xrepo.outcomes(m, nodes), nodes, pins, "mappings", "1")


@query("xrepo_edges", f"""WITH {_XREPO}, ok AS (SELECT xo.*, xm.name FROM xo JOIN xm ON xm.id = xo.id WHERE outcome = 'connected')
SELECT 'depends-on-coordinate' AS kind, consumer AS node, id AS label FROM ok UNION ALL SELECT DISTINCT 'coordinate-resolves-to', producer, name FROM ok""")
def xrepo_edges(spark, sf):
    """Consumers depend on coordinates, which resolve to producers."""
    e = G.merge_edges(_composed(spark, sf)[1])
    out = F.col("kind") == "depends-on-coordinate"
    return e.select("kind", F.when(out, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(out, F.col("edge_key")).otherwise(F.get_json_object("edge_key", "$.name")).alias("label"))


@query("xrepo_coordinates", f"""WITH {_XREPO}, ok AS (SELECT xm.name, xm.cr, xm.ck, p.repository AS pr, p.key AS pk FROM xo JOIN xm ON xm.id = xo.id JOIN xn p ON p.id = xo.producer WHERE outcome = 'connected')
SELECT name, count(*) AS records FROM (SELECT name, cr AS r, ck AS k FROM ok UNION SELECT name, pr, pk FROM ok) GROUP BY name""")
def xrepo_coordinates(spark, sf):
    """Coordinates as nodes, with evidence pinned to both snapshots."""
    n = G.merge_nodes(_composed(spark, sf)[0])
    return n.select(F.get_json_object("metadata", "$.name").alias("name"), F.size("provenance").cast("long").alias("records"))


@query("xrepo_diagnostics", f"""WITH {_XREPO} SELECT outcome AS code, CASE WHEN outcome = 'cross-repo-producer-ambiguous' THEN 'partial' ELSE 'unresolved' END AS state, xm.ck AS path,
CASE WHEN xm.cr = 'nowhere' THEN (SELECT min(repository) FROM xn) ELSE xm.cr END AS repository FROM xo JOIN xm ON xm.id = xo.id WHERE outcome <> 'connected'""")
def xrepo_diagnostics(spark, sf):
    """Mappings that are not connected, told at their consumers."""
    return _composed(spark, sf)[2].select("code", "state", F.col("provenance.path").alias("path"), F.col("provenance.repository").alias("repository"))


# --------------------------------------------------------------------- plugins
def _notes(spark, request):
    """A note for each event type; one in a kind that is not declared, one edge to nowhere."""
    proof = evidence(repository="events", ref="main", origin="derived", method="deterministic-extraction", state="complete", extractor=F.struct(F.lit("notes").alias("name"), F.lit("1").alias("version")))
    none = F.lit(None).cast("string")
    types = request["graph"].nodes.select("id", "key")
    nodes = types.select(F.lit("events").alias("namespace"), F.explode(F.array(F.lit("note"), F.lit("secret"))).alias("kind"), "key", none.alias("metadata"), proof.alias("provenance")).where("kind = 'note' or key = 'view'")
    to = F.when(F.col("key") == "view", "node:nowhere").otherwise(F.col("id"))
    edges = types.select(F.lit("annotates").alias("kind"), node_id(F.lit("events"), F.lit("note"), "key").alias("src"), to.alias("dst"), none.alias("edge_key"), none.alias("metadata"), proof.alias("provenance"))
    return nodes, edges


def _broken(spark, request):
    raise RuntimeError("no parser")


@query("plugin_run", f"""WITH {SQL_EVENTS} SELECT 'node' AS what, key AS label FROM en UNION ALL SELECT 'edge', key FROM en WHERE key <> 'view'
UNION ALL SELECT 'diagnostic', 'extractor-failed' FROM en WHERE key = 'view' UNION ALL SELECT 'diagnostic', 'extractor-invalid-node' FROM en WHERE key = 'view' UNION ALL SELECT 'diagnostic', 'extractor-invalid-edge' FROM en WHERE key = 'view'""")
def plugin_run(spark, sf):
    """Two plugins over one base graph, of which one fails."""
    describe = lambda name: plugin.Descriptor(name, "1", "s/1", ("deterministic-extraction",), ("complete",), ("note",), ("annotates",))
    g = plugin.run_plugins(D.event_graph(spark, sf), [plugin.Plugin(describe("notes"), _notes), plugin.Plugin(describe("broken"), _broken)], {"repository": "events", "ref": "main"})
    notes = g.nodes.where("kind = 'note'").select("id", "key")
    edges = g.edges.where("kind = 'annotates'").join(notes.withColumnRenamed("id", "src"), "src")
    return notes.select(F.lit("node").alias("what"), F.col("key").alias("label")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("key").alias("label"))).unionByName(g.diagnostics.select(F.lit("diagnostic").alias("what"), F.col("code").alias("label")))


# ------------------------------------------------------------------- snapshots
@query("snapshot_round_trip", f"WITH {SQL_EVENTS} SELECT 'node' AS what, id AS a, key AS b FROM en UNION ALL SELECT 'edge', src, dst FROM ee")
def snapshot_round_trip(spark, sf):
    """A graph that was written to a store and loaded by its identity."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    g, _ = snapshot.ensure_snapshot(store, lambda: D.event_graph(spark, sf), "events", "main", "c1")
    return g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("key").alias("b")).unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("snapshot_reuse", f"WITH {SQL_EVENTS}, k AS (SELECT (SELECT count(*) FROM en) AS nodes, (SELECT count(*) FROM ee) AS edges, (SELECT count(*) FROM ee JOIN en ON en.id = ee.src WHERE en.key = 'view') AS gone) SELECT 'first' AS snapshot, nodes + edges AS written, 0 AS reused FROM k UNION ALL SELECT 'second', 0, nodes + edges - gone FROM k")
def snapshot_reuse(spark, sf):
    """A later snapshot writes only facts that the store doesn't have."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    g = D.event_graph(spark, sf)
    less = g.edges.join(g.nodes.where("key = 'view'").select(F.col("id").alias("src")), "src", "left_anti")
    done = [snapshot.write_snapshot(store, x, "events", "main", f"c{i}") for i, x in enumerate((g, G.Graph(g.nodes, less, g.diagnostics)))]
    return spark.createDataFrame([(name, d["written"], d["reused"]) for name, d in zip(("first", "second"), done)], "snapshot string, written long, reused long")
