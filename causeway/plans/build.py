"""A repository's whole graph, built cold or from what earlier commits left.

Three things are kept in a store. What a blob says, its imports and exports or its
manifest, is addressed by the blob, so a rename parses nothing and an edit one blob; only
blobs that are not known are read. A commit's relations (facts, diagnostics and the keys
they wait for) are a state of their own: a build that names a ``base`` with a state
resolves only the files that the changes can affect and takes all other rows from there.
A state is complete once its pointer is renamed into place, so a lost driver leaves none
that is half. Either way the graph equals a cold build's.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.identity import evidence, keyed_hash, node_id
from causeway.functions.lineage import cut
from causeway.operators import extract, ingest, rules
from causeway.operators.graph import Graph, build
from causeway.sources import git

SYNTAX = "sha string, script string, imports array<struct<relation:string,specifier:string,type_only:boolean>>, exports array<string>"
SYNTAX_TABLE = "syntax-2"  # facts of readers before the second are not read
MANIFEST_TABLE = "manifests-1"
EXTRACTOR = ("causeway-relations", "2")
STATE = {"facts": "kind string, src_kind string, src string, dst_kind string, dst string, key string, metadata string", "said": extract.SAID, "keys": "key string, owner string", "files": "path string, sha string"}


@dataclass
class Build:
    graph: Graph
    commit: str
    #: (key, owner): what the owners' facts wait for
    keys: DataFrame
    #: parsed, reused: source blobs; resolved, kept: files; mode: cold or incremental
    metrics: dict


def configuration_identity(policy: ingest.IngestionPolicy = ingest.IngestionPolicy(), discover_rules: bool = True, path_rules: tuple[tuple[str, tuple[str, ...]], ...] = (), analysis: dict | None = None) -> str:
    """The address of all that decides, besides the commit, what a build gives."""
    chosen = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(policy).items()}
    return keyed_hash("snapshot-config-sha256-", {"policy": chosen, "discoverRules": discover_rules, "pathRules": [[p, list(t)] for p, t in path_rules], "extractor": list(EXTRACTOR), "analysis": analysis or {}})


def _known(spark: SparkSession, store: str | None, table: str, schema) -> DataFrame | None:
    if not store:
        return None
    try:
        known = spark.read.schema(schema).parquet(f"{store}/{table}")
        known.head(1)
        return known
    except AnalysisException:
        return None


class State:
    """The stored relations of one commit under one configuration."""

    def __init__(self, spark: SparkSession, store: str, repository: str, commit: str, configuration: str):
        self.spark = spark
        self.at = f"{store}/relations/{keyed_hash('', {'repository': repository, 'commit': commit, 'configuration': configuration})}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.at).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> dict | None:
        path, fs = self._fs()
        if not fs.exists(path(f"{self.at}/complete.json")):
            return None
        named = json.loads(self.spark.read.text(f"{self.at}/complete.json", wholetext=True).first().value)
        return {t: self.spark.read.schema(schema).parquet(f"{self.at}/{named['folder']}/{t}") for t, schema in STATE.items()} | {"tsconfig": named["tsconfig"]}

    def write(self, tables: dict[str, DataFrame], tsconfig: str | None) -> None:
        folder = keyed_hash("", {"time": self.spark._jvm.java.lang.System.nanoTime()})[:16]
        for t, schema in STATE.items():
            tables[t].write.parquet(f"{self.at}/{folder}/{t}")
        path, fs = self._fs()
        hidden = path(f"{self.at}/.{folder}.json")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps({"folder": folder, "tsconfig": tsconfig}).encode()))
        out.close()
        fs.rename(hidden, path(f"{self.at}/complete.json"))  # an earlier one stays, and is as good


def build_repository(spark: SparkSession, root: str, ref: str, repository: str, store: str | None = None, policy: ingest.IngestionPolicy = ingest.IngestionPolicy(), base: str | None = None, discover_rules: bool = True, path_rules: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> Build:
    """The graph of ``ref``. ``path_rules`` are further (pattern, targets) after those
    of the repository's own rule file; ``base`` is a ref whose state in the ``store`` may serve."""
    at = git.resolve(root, ref)
    entries = cut(git.tree_entries(spark, root, at["commit"]), "entries")
    leaves = entries.where("type <> 'tree'")
    links = cut(git.blobs(leaves.where("mode = '120000'"), root), "links")
    looked_at = leaves.join(cut(git.blobs(leaves, root), "blobs"), "sha", "left") if policy.exclude_binary else leaves
    decided = ingest.decide(looked_at, policy).select("mode", "type", "sha", "path", "decision")
    decided = cut(decided.join(links.select("sha", F.col("content").cast("string").alias("link")), "sha", "left").select("mode", "type", "sha", "path", "decision", F.when(F.col("mode") == "120000", F.col("link")).alias("target")), "decided")
    nodes, edges, diags = ingest.tree_graph(decided, repository, ref, at["commit"])
    files = cut(decided.where(ingest.is_kept() & (F.col("type") == "blob") & (F.col("mode") != "120000")).select("path", "sha"), "files")
    known, packed = _known(spark, store, SYNTAX_TABLE, SYNTAX), _known(spark, store, MANIFEST_TABLE, extract.T_MANIFEST)
    sources, manifests = extract.is_source(F.col("path")), extract.is_manifest(F.col("path"))
    wanted = files.where(sources).select("path", "sha", extract.script_kind(F.col("path")).alias("script"))
    fresh = wanted if known is None else wanted.join(known.select("sha", "script"), ["sha", "script"], "left_anti")
    unread = files.where(manifests) if packed is None else files.where(manifests).join(packed.select("sha"), "sha", "left_anti")
    rule_file = rules.rule_file(entries).select("path", "sha") if discover_rules else files.where("false")
    read = fresh.select("path", "sha").unionByName(unread.select("path", "sha")).unionByName(files.where("path = 'tsconfig.json'")).unionByName(rule_file)
    content = cut(git.blobs(read.withColumn("type", F.lit("blob")), root), "content")
    texts = cut(read.distinct().join(content, "sha").select("path", "sha", F.col("content").cast("string").alias("text")), "texts")
    new = cut(extract.syntax_facts(texts, known), "syntax")
    new_packages = cut(extract.manifest_facts(texts, packed), "manifests")
    parsed = new.count()
    if store and parsed:
        new.write.mode("append").parquet(f"{store}/{SYNTAX_TABLE}")
    if store and new_packages.head(1):
        new_packages.write.mode("append").parquet(f"{store}/{MANIFEST_TABLE}")
    syntax = new if known is None else new.unionByName(known.join(files.select("sha"), "sha", "left_semi").dropDuplicates(["sha", "script"]))
    packages = new_packages if packed is None else new_packages.unionByName(packed.dropDuplicates(["sha"]))
    config = texts.where("path = 'tsconfig.json'").select("text").first()
    tsconfig = config.text if config else None
    chosen = configuration_identity(policy, discover_rules, path_rules)
    held = State(spark, store, repository, git.resolve(root, base)["commit"], chosen).read() if store and base else None
    total = files.count()
    if held is None or held["tsconfig"] != tsconfig:
        held, resolved = None, total
        facts, said, keys = (cut(x, "relations") for x in extract.all_relations(files, syntax, packages, tsconfig))
    else:
        owners = cut(extract.affected_owners(held["files"], files, held["keys"], packages), "owners")
        resolved = owners.count()
        gone = held["files"].select("path").join(files.select("path"), "path", "left_anti").unionByName(owners)
        made = extract.all_relations(files, syntax, packages, tsconfig, owners)
        stays = [held[t].join(gone.select(F.col("path").alias(c)), c, "left_anti") for t, c in (("facts", "src"), ("said", "owner"), ("keys", "owner"))]
        made = (made[0], made[1].where("owner <> ''"), made[2])  # what is said of the whole repository stays
        facts, said, keys = (cut(x.unionByName(y), "relations") for x, y in zip(stays, made))
    if store:
        state = State(spark, store, repository, at["commit"], chosen)
        if state.read() is None:
            state.write({"facts": facts, "said": said, "keys": keys, "files": files}, tsconfig)
    named = F.struct(F.lit(EXTRACTOR[0]).alias("name"), F.lit(EXTRACTOR[1]).alias("version"))
    proof = lambda path, state="complete": evidence(repository=repository, ref=ref, commit=at["commit"], path=path, origin="derived", method="deterministic-extraction", state=state, extractor=named)
    ns = F.lit(repository)
    made = facts.where("dst_kind in ('symbol', 'package') and kind in ('exports', 'declares-package')").select(ns.alias("namespace"), F.col("dst_kind").alias("kind"), F.col("dst").alias("key"), "metadata", proof(F.col("src")).alias("provenance"))
    linked = facts.select("kind", node_id(ns, "src_kind", "src").alias("src"), node_id(ns, "dst_kind", "dst").alias("dst"), F.col("key").alias("edge_key"), F.when(F.col("kind") != "declares-package", F.col("metadata")).alias("metadata"), proof(F.col("src")).alias("provenance"))
    told = said.select("code", F.concat_ws(": ", "code", "subject").alias("message"), "state", proof(F.lit(None).cast("string"))[0].withField("state", F.col("state")).alias("provenance"))
    rule_nodes, rule_edges = _path_rules(spark, decided, texts.join(rule_file.select("path"), "path", "left_semi"), path_rules, repository, ref, at["commit"])
    g = build(nodes.unionByName(made).unionByName(rule_nodes), edges.unionByName(linked).unionByName(rule_edges), diags.unionByName(told), distinct_diagnostics=True)
    all_sources = wanted.select("sha", "script").distinct().count()
    mode = "cold" if known is None else "incremental"
    return Build(g, at["commit"], keys, {"mode": mode, "parsed": parsed, "reused": all_sources - parsed, "resolved": resolved, "kept": total - resolved})


def _path_rules(spark: SparkSession, decided: DataFrame, rule_file: DataFrame, more: tuple[tuple[str, tuple[str, ...]], ...], repository: str, ref: str, commit: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge facts of the repository's own rules, then of ``more``."""
    own = [(r.ord, r.pattern, r.targets, r.source_path) for r in rules.parse_rules(rule_file).orderBy("ord").collect()]  # one file
    rows = own + [(len(own) + k, p, list(t), None) for k, (p, t) in enumerate(more)]
    table = spark.createDataFrame(rows, "ord long, pattern string, targets array<string>, source_path string")
    kept = decided.where(ingest.is_kept()).select("path", ingest.entry_kind(F.col("mode"), F.col("type")).alias("path_kind"))
    hits = rules.match_rules(kept, [(r[0], r[1]) for r in rows]).join(kept, "path")
    return rules.rule_facts(table, hits, repository, ref, commit)
