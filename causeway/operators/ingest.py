"""From tree entries to a graph: filters, directories, containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.identity import evidence, node_id
from causeway.functions.paths import ancestors, matches_any, parent

MAX_BINARY_BYTES = 1 << 20


@dataclass(frozen=True)
class IngestionPolicy:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    vendor: tuple[str, ...] = ()
    exclude_binary: bool = False
    max_binary_bytes: int = MAX_BINARY_BYTES


def parse_tree(raw: DataFrame) -> DataFrame:
    """(mode, type, sha, path) of NUL-separated ``mode type sha\\tpath`` listings."""
    lines = raw.select(F.explode(F.split("value", "\u0000")).alias("line")).where("line <> ''")
    part = lambda i: F.regexp_extract("line", r"(?s)^(\d{6}) (blob|tree|commit) ([0-9a-f]+) *[\d-]*\t(.+)$", i)
    bad = F.raise_error(F.concat(F.lit("malformed tree entry: "), F.col("line")))
    return lines.select(F.when(part(1) == "", bad).otherwise(part(1)).alias("mode"), part(2).alias("type"), part(3).alias("sha"), part(4).alias("path"))


def entry_kind(mode: Column, type_: Column) -> Column:
    return F.when(type_ == "tree", "directory").when((type_ == "commit") | (mode == "160000"), "submodule").when(mode == "120000", "symlink").otherwise("file")


def has_nul(content: Column) -> Column:
    """A NUL byte among the first 8192."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")


def decide(leaves: DataFrame, policy: IngestionPolicy) -> DataFrame:
    """``leaves`` (path, and size and content where binaries matter) with the
    decision: kept, silent, or the code of the diagnostic. The first test counts."""
    path = F.col("path")
    out = F.when(~matches_any(path, list(policy.include)), "silent") if policy.include else F.when(F.lit(False), "")
    for code, patterns in (("path-excluded", policy.exclude), ("generated-excluded", policy.generated), ("vendor-excluded", policy.vendor)):
        if patterns:
            out = out.when(matches_any(path, list(patterns)), code)
    if policy.exclude_binary:
        out = out.when(F.col("size") > policy.max_binary_bytes, "binary-check-skipped").when(has_nul(F.col("content")), "binary-excluded")
    return leaves.withColumn("decision", out.otherwise("kept"))


def is_kept() -> Column:
    return F.col("decision").isin("kept", "binary-check-skipped")


def ingestion_diagnostics(decided: DataFrame) -> DataFrame:
    """(code, path): all decisions that are reported."""
    return decided.where(~F.col("decision").isin("kept", "silent")).select(F.col("decision").alias("code"), "path")


def required_directories(kept: DataFrame) -> DataFrame:
    """(path) of the directories above the leaves that stay."""
    return kept.select(F.explode(ancestors("path")).alias("path")).distinct()


def contains(entries: DataFrame, namespace: str, root_key: str) -> DataFrame:
    """(kind, src, dst): each entry (path, kind) in its directory or the root."""
    up = parent("path")
    above = F.when(up == "", node_id(F.lit(namespace), F.lit("repository"), F.lit(root_key))).otherwise(node_id(F.lit(namespace), F.lit("directory"), up))
    return entries.select(F.lit("contains").alias("kind"), above.alias("src"), node_id(F.lit(namespace), "kind", "path").alias("dst"))


def tree_graph(decided: DataFrame, namespace: str, ref: str, commit: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node facts, edge facts and diagnostics of a filtered tree (mode, type,
    sha, path, decision, and target, the text of a symlink, where it was read)."""
    none = F.lit(None).cast("string")
    target = F.col("target") if "target" in decided.columns else none
    leaves = decided.where(is_kept()).select("path", entry_kind(F.col("mode"), F.col("type")).alias("kind"), "sha", "mode", target.alias("target"))
    dirs = required_directories(leaves).select("path", F.lit("directory").alias("kind"), none.alias("sha"), F.lit("040000").alias("mode"), none.alias("target"))
    entries = leaves.unionByName(dirs)
    proof = lambda path: evidence(repository=namespace, ref=ref, commit=commit, path=path, origin="source", method="source-observation", state="complete")
    spark = decided.sparkSession
    root = spark.range(1).select(F.lit(namespace).alias("namespace"), F.lit("repository").alias("kind"), F.lit(".").alias("key"), F.to_json(F.struct(F.lit(commit).alias("commit"))).alias("metadata"), proof(None).alias("provenance"))
    nodes = entries.select(F.lit(namespace).alias("namespace"), "kind", F.col("path").alias("key"), F.to_json(F.struct("mode", F.col("sha").alias("object"), "target")).alias("metadata"), proof(F.col("path")).alias("provenance"))
    edges = contains(entries, namespace, ".").join(entries.select(node_id(F.lit(namespace), "kind", "path").alias("dst"), "path"), "dst")
    edges = edges.select("kind", "src", "dst", F.lit(None).cast("string").alias("edge_key"), F.lit(None).cast("string").alias("metadata"), proof(F.col("path")).alias("provenance"))
    said = ingestion_diagnostics(decided)
    diags = said.select("code", F.concat_ws(": ", "code", "path").alias("message"), F.lit("partial").alias("state"), proof(F.col("path"))[0].withField("state", F.lit("partial")).alias("provenance"))
    return root.unionByName(nodes), edges, diags
