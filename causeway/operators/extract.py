"""Import, package and test relations of a filtered tree, by joins.

Inputs are ``files`` (path, sha) of one commit, and what their blobs say: ``syntax``
(sha, script, imports, exports) and ``packages`` (sha, and the manifest's fields). Results
are rows of facts (kind, src_kind, src, dst_kind, dst, key, metadata), of which ``src``
is the path that owns them, diagnostics (owner, code, state, subject) and keys (key,
owner): what else an owner's facts depend on, the existence of ``file:path`` and the
packages of ``name:name``. With ``owners`` (path) only their rows are resolved.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.functions.lineage import cut
from causeway.functions.paths import ancestors, parent, resolved
from causeway.functions.syntax import MANIFEST, manifest_of, syntax_of
from causeway.operators.relations import first_candidate, is_source, is_test, module_candidates, nearest_owner, script_kind, test_candidates, unique_match

SAID = "owner string, code string, state string, subject string"
FACT = ["kind", "src_kind", "src", "dst_kind", "dst", "key", "metadata"]
T_MANIFEST = T.StructType([T.StructField("sha", T.StringType()), *MANIFEST.fields])
SYNTAX_VERSION = "causeway.syntax/2"


def _fact(df: DataFrame, kind: Column | str, src_kind: str, src: str, dst_kind: str, dst: str, key: Column, metadata: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    return df.select(kind.alias("kind"), F.lit(src_kind).alias("src_kind"), F.col(src).alias("src"), F.lit(dst_kind).alias("dst_kind"), F.col(dst).alias("dst"), key.alias("key"), (none if metadata is None else metadata).alias("metadata"))


def syntax_facts(files: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(sha, script, imports, exports) of each distinct source blob and script kind;
    those that ``cached`` has are not parsed again."""
    new = files.where(is_source(F.col("path"))).select("sha", script_kind(F.col("path")).alias("script"), "text").dropDuplicates(["sha", "script"])
    if cached is not None:
        new = new.join(cached.select("sha", "script"), ["sha", "script"], "left_anti")
    return new.select("sha", "script", syntax_of("text", "script").alias("s")).select("sha", "script", "s.*")


def manifest_facts(files: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(sha, name, version, dependencies, entrypoints, problem) of each distinct
    manifest blob (path, sha, text) that ``cached`` does not have."""
    new = files.where(is_manifest(F.col("path"))).select("sha", "text").dropDuplicates(["sha"])
    if cached is not None:
        new = new.join(cached.select("sha"), "sha", "left_anti")
    return new.select("sha", manifest_of("text").alias("m")).select("sha", "m.*")


def is_manifest(path: Column) -> Column:
    return path.rlike(r"(?:^|/)package\.json\z")


def _of(df: DataFrame, owners: DataFrame | None, path: str = "path") -> DataFrame:
    return df if owners is None else df.join(owners.select(F.col("path").alias(path)), path, "left_semi")


def _key(prefix: str, of: Column | str, owner: str = "path") -> list[Column]:
    return [F.concat(F.lit(prefix), of).alias("key"), F.col(owner).alias("owner")]


def read_tsconfig(text: str | None) -> tuple[str | None, list[tuple[str, list[str]]], str | None]:
    """(baseUrl, [(pattern, targets)] by precedence, problem) of the root
    tsconfig: exact patterns first, then longer ones."""
    if text is None:
        return None, [], None
    import re

    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    try:
        options = json.loads(plain).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return None, [], "tsconfig is not readable; aliases are off"
    paths = [(p, [t for t in ts if isinstance(t, str)]) for p, ts in (options.get("paths") or {}).items() if isinstance(ts, list)]
    return options.get("baseUrl"), sorted(paths, key=lambda x: ("*" in x[0], -len(x[0]))), None


def import_candidates(imports: DataFrame, base_url: str | None, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """``imports`` (path, specifier) with ``candidates``: null for an external
    module. Once an alias matches, nothing else is tried."""
    spec = F.col("specifier")
    out = F.when(spec.rlike(r"^\.{1,2}(/|\z)"), module_candidates(resolved(parent("path"), spec)))
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        hit = (spec == pattern) if not star else spec.startswith(head) & spec.endswith(tail)
        mid = F.when(F.length(spec) >= len(head) + len(tail), F.expr(f"substring(specifier, {len(head) + 1}, length(specifier) - {len(head) + len(tail)})")).otherwise("") if star else F.lit("")
        tried = [module_candidates(resolved(F.lit(base_url or ""), F.concat(F.lit(t.partition("*")[0]), mid, F.lit(t.partition("*")[2])) if "*" in t else F.lit(t))) for t in targets]
        out = out.when(hit, F.concat(*tried) if tried else F.array().cast("array<string>"))
    return imports.withColumn("candidates", out)


def import_relations(files: DataFrame, syntax: DataFrame, tsconfig: str | None = None, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, diagnostics, candidates (owner, specifier, candidate)). Candidates
    that do not exist are kept too: a file added there must wake its importers."""
    base_url, aliases, problem = read_tsconfig(tsconfig)
    own = _of(files.where(is_source(F.col("path"))), owners).select("path", "sha", script_kind(F.col("path")).alias("script")).join(syntax, ["sha", "script"])
    exports = own.select("path", F.explode("exports").alias("name")).withColumn("symbol", F.concat("path", F.lit("#export:"), "name"))
    facts = _fact(exports, "exports", "file", "path", "symbol", "symbol", F.lit(None).cast("string"))
    imports = own.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    tried = import_candidates(imports, base_url, aliases)
    external = tried.where("candidates is null")
    inner = tried.where("candidates is not null")
    found = first_candidate(inner.select(F.col("path").alias("owner"), "specifier", "candidates").dropDuplicates(["owner", "specifier"]), files.select("path").distinct())
    joined = inner.join(found.withColumnRenamed("owner", "path"), ["path", "specifier"])
    edge = joined.where("target is not null").withColumn("key", F.concat_ws(":", "relation", "specifier"))
    kind = F.when(F.col("relation") == "reexport", "reexports").otherwise("imports")
    facts = facts.unionByName(_fact(edge, kind, "file", "path", "file", "target", F.col("key"), F.to_json(F.struct("relation", "specifier", F.col("type_only").alias("typeOnly")))))
    said = _told(external, "tsjs-external-module", "partial", F.concat_ws(" -> ", "path", "specifier"))
    said = said.unionByName(_told(joined.where("target is null"), "tsjs-unresolved-import", "unresolved", F.concat_ws(" -> ", "path", "specifier")))
    if problem:
        said = said.unionByName(files.sparkSession.createDataFrame([("", "tsjs-invalid-tsconfig", "partial", problem)], SAID))
    wanted = inner.select(F.col("path").alias("owner"), "specifier", F.explode("candidates").alias("candidate")).where("candidate is not null")
    return facts, said.distinct(), wanted


def _told(df: DataFrame, code: str, state: str, subject: Column) -> DataFrame:
    return df.select(F.col("path").alias("owner"), F.lit(code).alias("code"), F.lit(state).alias("state"), subject.alias("subject"))


def package_relations(files: DataFrame, packages: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages, their files, local dependencies and entry points: (facts, diagnostics, keys)."""
    parsed = files.where(is_manifest(F.col("path"))).select("path", "sha", parent("path").alias("directory")).join(packages, "sha")
    good = parsed.where("problem is null").select("*", F.concat(F.lit("npm:"), "path").alias("package"))
    mine = _of(good, owners)
    paths = files.select("path")
    info = F.to_json(F.struct(F.lit("npm").alias("ecosystem"), F.col("path").alias("manifestPath"), "name", "version"))
    facts = _fact(mine, "declares-package", "file", "path", "package", "path", F.lit(None).cast("string"), info)
    owner = nearest_owner(_of(paths, owners), good.select("directory", F.col("path").alias("owner")))
    facts = facts.unionByName(_fact(owner, "belongs-to-package", "file", "path", "package", "owner", F.lit(None).cast("string")))
    said = _told(_of(parsed.where("problem is not null"), owners), "repository-relations-invalid-package-json", "partial", F.col("path"))
    deps = mine.select("path", "directory", F.explode("dependencies").alias("d")).select("path", "directory", "d.*")
    names = good.where("name is not null").groupBy("name").agg(F.count("*").alias("matches"), F.min("path").alias("one"))
    work = deps.where("spec like 'workspace:%'").join(names, "name", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    local = deps.where("spec like 'file:%' or spec like 'link:%'").withColumn("at", resolved(F.col("directory"), F.regexp_replace("spec", "^(file|link):", "")))
    keys = work.select(*_key("name:", "name")).unionByName(local.where("at is not null").select(*_key("file:", F.concat(F.col("at"), F.when(F.col("at") == "", "").otherwise("/"), F.lit("package.json")))))
    local = local.join(good.select(F.col("directory").alias("at"), F.col("path").alias("one")), "at", "left")
    linked = work.where("matches = 1").select("path", "field", "name", "spec", "one").unionByName(local.where("one is not null").select("path", "field", "name", "spec", "one"))
    facts = facts.unionByName(_fact(linked, "package-dependency", "package", "path", "package", "one", F.concat_ws(":", "field", "name"), F.to_json(F.struct("field", "name", "spec"))))
    for code, test, state in (("ambiguous", "matches > 1", "partial"), ("unresolved", "matches = 0", "unresolved")):
        said = said.unionByName(_told(work.where(test), f"repository-relations-{code}-workspace-dependency", state, F.concat_ws(" -> ", "path", "name")))
    entries = mine.select("path", "directory", F.explode("entrypoints").alias("e")).select("path", "e.*", resolved(F.col("directory"), F.col("e.target")).alias("at"))
    keys = keys.unionByName(entries.where("at is not null").select(*_key("file:", "at")))
    entries = entries.join(paths.select(F.col("path").alias("at"), F.lit(True).alias("there")), "at", "left")
    kind = F.when(F.col("relation") == "contract", "package-contract").otherwise("package-build-entrypoint")
    facts = facts.unionByName(_fact(entries.where("there"), kind, "package", "path", "file", "at", F.col("field")))
    return facts, said.unionByName(_told(entries.where("there is null"), "repository-relations-unresolved-entrypoint", "unresolved", F.concat_ws(" -> ", "path", "target"))), keys


def test_relations(files: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests and the one source each covers; several are a diagnostic: (facts, diagnostics, keys)."""
    paths = files.select("path")
    tests = _of(paths.where(is_test(F.col("path"))), owners).select("path", F.explode(test_candidates(F.col("path"))).alias("candidate")).where("candidate <> path").distinct()
    found = unique_match(tests, paths.select(F.col("path").alias("candidate"), F.col("path").alias("source")), "candidate", "path", "source")
    facts = _fact(found.where("matches = 1"), "tests", "file", "path", "file", "target", F.lit(None).cast("string"))
    return facts, _told(found.where("matches > 1"), "repository-relations-ambiguous-test-source", "partial", F.col("path")), tests.select(*_key("file:", "candidate"))


def all_relations(files: DataFrame, syntax: DataFrame, packages: DataFrame, tsconfig: str | None, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, diagnostics, keys) of all kinds."""
    facts, said, wanted = import_relations(files, syntax, tsconfig, owners)
    keys = wanted.select(*_key("file:", "candidate", "owner"))
    for more, told, need in (package_relations(files, packages, owners), test_relations(files, owners)):
        facts, said, keys = facts.unionByName(more), said.unionByName(told), keys.unionByName(need)
    return facts.select(*FACT), said, keys.distinct()


def affected_owners(base: DataFrame, target: DataFrame, keys: DataFrame, packages: DataFrame) -> DataFrame:
    """(path) of the target's files whose facts may differ from those in the base.

    ``base`` and ``target``: files (path, sha); ``keys``: the base's (key, owner);
    ``packages``: the manifests' facts of both. A changed file is affected, so is who
    waits for a path that came or went, or for a name of a changed manifest, and every file
    below a changed manifest.
    """
    both = base.select("path", F.col("sha").alias("was")).join(target.select("path", F.col("sha").alias("now")), "path", "full").where("not was <=> now")
    both = cut(both, "changed")
    manifests = both.where(is_manifest(F.col("path")))
    named = manifests.select(F.explode(F.array("was", "now")).alias("sha")).join(packages, "sha").where("name is not null").select(F.concat(F.lit("name:"), "name").alias("key"))
    moved = both.where("was is null or now is null").select(F.concat(F.lit("file:"), "path").alias("key")).unionByName(manifests.select(F.concat(F.lit("file:"), "path").alias("key")))
    woken = keys.join(named.unionByName(moved).distinct(), "key", "left_semi").select(F.col("owner").alias("path"))
    above = target.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors("path"))).alias("directory"))
    below = above.join(manifests.select(parent("path").alias("directory")).distinct(), "directory", "left_semi").select("path")
    return both.select("path").unionByName(woken).unionByName(below).distinct().join(target.select("path"), "path", "left_semi")
