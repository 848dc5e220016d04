"""Path rules: patterns with targets, of which the last match holds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from causeway.functions.identity import node_id, provenance
from causeway.functions.paths import ancestors, glob_regex, normalized

FEW = 64

#: Where a file of rules may stand, in this order (fixed values).
RULE_FILES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def parse_rules(files: DataFrame) -> DataFrame:
    """(source_path, ord, pattern, targets) of rule files (path, text): one rule
    a line, without blank lines, comments and lines that name no target."""
    lines = files.select(F.col("path").alias("source_path"), F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
    words = F.split(F.trim("text"), r"\s+")
    rules = lines.where(~F.col("text").rlike(r"^\s*(#|$)")).select("source_path", "line", words[0].alias("pattern"), F.expr("slice(split(trim(text), '\\\\s+'), 2, 1000000)").alias("targets"))
    rules = rules.where(F.size("targets") > 0)
    return rules.select("source_path", (F.row_number().over(W.partitionBy("source_path").orderBy("line")) - 1).alias("ord"), "pattern", "targets")


def rule_file(entries: DataFrame) -> DataFrame:
    """The rule file that counts: the first place that is a regular blob."""
    rank = F.lit(None)
    for i, at in reversed(list(enumerate(RULE_FILES))):
        rank = F.when(F.col("path") == at, i).otherwise(rank)
    found = entries.where(F.col("path").isin(*RULE_FILES) & (F.col("type") == "blob") & (F.col("mode") != "120000"))
    return found.withColumn("rank", rank).orderBy("rank").limit(1).drop("rank")


def match_rules(paths: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """(path, ord, pattern, effective) of each match.

    Up to ``FEW`` rules become tests of one projection, and the last match is the
    largest index of the row's array, which takes no window; more are joined by their
    literals. Both give the same rows.
    """
    if len(rules) > FEW:
        return match_many(paths, paths.sparkSession.createDataFrame([(o, p) for o, p in rules], "ord long, pattern string"))
    tests = []
    for ord_, pattern in sorted(rules):
        regex = glob_regex(pattern)
        if regex is not None:
            tests.append(F.when(F.col("path").rlike("(?s)" + regex), F.struct(F.lit(ord_).cast("long").alias("ord"), F.lit(pattern).alias("pattern"))))
    if not tests:
        return paths.select("path", F.lit(0).cast("long").alias("ord"), F.lit("").alias("pattern"), F.lit(False).alias("effective")).where("false")
    hits = paths.select("path", F.array_compact(F.array(*tests)).alias("hits")).where(F.size("hits") > 0)
    last = F.col("hits")[F.size("hits") - 1]["ord"]
    return hits.select("path", last.alias("last"), F.explode("hits").alias("h")).select("path", "h.ord", "h.pattern", (F.col("h.ord") == F.col("last")).alias("effective"))


_KEYED = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "regex")])


def rule_key(pattern: str) -> tuple[str, str] | None:
    """(key, regular expression) of a glob: what every path that it matches has.

    That is, in this order, the literal directories that an anchored glob begins with, its
    longest literal segment, or the ending of its last one; else nothing (``*``).
    """
    regex = glob_regex(pattern)
    if regex is None:
        return None
    parts = normalized(pattern.strip()).rstrip("/").split("/")
    literal = [not set(s) & set("*?") for s in parts]
    lead = next((i for i, ok in enumerate(literal) if not ok), len(parts))
    if len(parts) > 1 and lead:
        return "p:" + "/".join(parts[:lead]), regex
    # behind a segment such as a** there may be no slash
    whole = [s for i, s in enumerate(parts) if literal[i] and (not i or parts[i - 1] == "**" or not parts[i - 1].endswith("**"))]
    if whole:
        return "s:" + max(whole, key=len), regex
    tail = re.split(r"[*?]", parts[-1])[-1]
    return ("e:" + tail[tail.rindex(".") :] if "." in tail else "*"), regex


def match_many(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ord, pattern, effective) of each match, for any number of ``rules`` (ord, pattern).

    A rule waits under one literal key; a path brings all of its own: the directories
    above it and itself, its segments and their endings. So an equi-join gives each path the few rules
    that may match it, and only those are tested. Globs without any literal wait
    under a key that all paths bring.
    """

    @F.pandas_udf(_KEYED)
    def keyed(pattern: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_key(p) or (None, None) for p in pattern], columns=_KEYED.names)

    of = rules.select("ord", "pattern", keyed("pattern").alias("k")).select("ord", "pattern", "k.*").where("key is not null")
    parts = F.split("path", "/")
    endings = F.filter(F.transform(parts, lambda s: F.regexp_extract(s, r"(\.[^.]*)$", 1)), lambda e: e != "")
    tag = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    keys = F.concat(tag("p:", F.concat(ancestors("path"), F.array("path"))), tag("s:", parts), tag("e:", endings), F.array(F.lit("*")))
    tried = paths.select("path", F.explode(F.array_distinct(keys)).alias("key")).join(of, "key")
    hits = tried.where(F.expr("path rlike concat('(?s)', regex)")).select("path", "ord", "pattern")
    return hits.withColumn("effective", F.col("ord") == F.max("ord").over(W.partitionBy("path")))


def rule_facts(rules: DataFrame, matches: DataFrame, repository: str, ref: str, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(node facts, edge facts): a node for each rule, an edge to each path it matches.

    ``rules``: ord, pattern, targets and source_path (null for a rule that an
    overlay gives); ``matches``: path, path_kind, ord, effective.
    """
    own = F.col("source_path").isNotNull()
    pick = lambda yes, no: F.when(own, F.lit(yes)).otherwise(F.lit(no))
    named = F.when(~own, F.struct(F.lit("causeway-path-rules").alias("name"), F.lit("1").alias("version")))
    proof = provenance(repository=repository, ref=ref, commit=commit, path=F.col("source_path"), origin=pick("source", "overlay"), method=pick("source-observation", "explicit-overlay"), state="complete", authority=F.when(~own, "advisory"), overlay=named)
    key = F.concat_ws(":", F.coalesce("source_path", F.lit("<overlay>")), F.col("ord").cast("string"), "pattern")
    rules = rules.withColumn("source", pick("repository", "overlay")).withColumn("rule_key", key).withColumn("proof", F.array(proof))
    metadata = F.to_json(F.struct(F.col("ord").alias("order"), "pattern", "source", F.col("source_path").alias("sourcePath"), "targets"))
    nodes = rules.select(F.lit(repository).alias("namespace"), F.lit("path-rule").alias("kind"), F.col("rule_key").alias("key"), metadata.alias("metadata"), F.col("proof").alias("provenance"))
    hit = matches.select("path", "path_kind", "ord", "effective").join(rules.select("ord", "rule_key", "proof"), "ord")
    edges = hit.select(
        F.lit("path-rule-match").alias("kind"), node_id(F.lit(repository), F.lit("path-rule"), "rule_key").alias("src"), node_id(F.lit(repository), "path_kind", "path").alias("dst"), F.lit(None).cast("string").alias("edge_key"),
        F.to_json(F.struct("effective")).alias("metadata"), F.col("proof").alias("provenance"),
    )
    return nodes, edges
