"""Relations between files: owners, packages, tests, import candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.paths import ancestors, parent

#: Endings tried for an extension-less specifier, in this order (fixed values).
SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")


def nearest_owner(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest directory above each path that ``owners``
    (directory, owner) has; '' is the root. Equi-joins on exploded ancestors."""
    above = paths.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors("path"))).alias("directory"))
    return above.join(owners, "directory").groupBy("path").agg(F.max_by("owner", F.length("directory")).alias("owner"))


def first_candidate(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(owner, specifier, target): the first of the ordered ``candidates`` (array)
    that is a file; null where none is."""
    tried = candidates.select("owner", "specifier", F.posexplode_outer("candidates").alias("pos", "path"))
    found = tried.join(files.select("path", F.lit(True).alias("there")), "path", "left")
    return found.groupBy("owner", "specifier").agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("pos"))).alias("target"))


#: Endings that a specifier's ending may stand for (fixed values).
STANDS_FOR = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".ts"), ".mjs": (".mts",), ".cjs": (".cts",)}


def module_candidates(base: Column) -> Column:
    """Paths that a resolved specifier may stand for, in order: itself, then for
    an ending of JavaScript its sources, and without an ending, for each known
    ending the file, then the directory's index."""
    ending = F.regexp_extract(base, r"[^/](\.[^./]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ending))
    out = F.when(ending == "", F.array(base, *[F.concat(base, F.lit(between + s)) for s in SUFFIXES for between in ("", "/index")]))
    for own, others in STANDS_FOR.items():
        out = out.when(ending == own, F.array(base, *[F.concat(stem, F.lit(s)) for s in others]))
    return out.otherwise(F.array(base))


def unique_match(left: DataFrame, right: DataFrame, on: str, id_: str, target: str) -> DataFrame:
    """(id, matches, target): the counterpart where exactly one exists."""
    found = left.join(right, on, "left").groupBy(id_).agg(F.count(target).alias("matches"), F.min(target).alias("one"))
    return found.select(id_, "matches", F.when(F.col("matches") == 1, F.col("one")).alias("target"))


#: How a test's file name shows its source's (fixed value).
TEST_NAME = r"^(?:.*/)?([^/]+)\.(?:test|spec)(\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs))$"


def test_candidates(path: Column) -> Column:
    """Sources that a test file may cover: the name without its mark beside it,
    and for a ``__tests__`` directory in the parent too; sorted. Files without the
    mark cover nothing."""
    name = F.concat(F.regexp_extract(path, TEST_NAME, 1), F.regexp_extract(path, TEST_NAME, 2))
    at = lambda up: F.when(up == "", name).otherwise(F.concat_ws("/", up, name))
    up = parent(path)
    above = F.when(up.rlike(r"(?:^|/)__tests__$"), F.array(at(parent(up)))).otherwise(F.array())
    return F.when(name != "", F.array_sort(F.array_distinct(F.concat(F.array(at(up)), above)))).otherwise(F.array().cast("array<string>"))


def is_test(path: Column) -> Column:
    """By the file's name alone; a directory of tests makes no test."""
    return path.rlike(TEST_NAME)


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs)\z")


def script_kind(path: Column) -> Column:
    """ts, tsx, js or jsx: how a source is read."""
    ending = F.regexp_extract(path, r"\.(\w+)\z", 1)
    return F.when(ending.isin("tsx", "jsx"), ending).when(ending.isin("js", "mjs", "cjs"), "js").otherwise("ts")
