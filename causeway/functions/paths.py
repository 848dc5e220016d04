"""Repository paths and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def normalized(path: str) -> str:
    """Forward slashes, without one leading ``./`` and without leading slashes."""
    path = path.replace("\\", "/").removeprefix("./")
    return path.lstrip("/")


def glob_regex(pattern: str) -> str | None:
    """A regular expression (Java and Python) for a repository glob.

    ``*`` and ``?`` stay inside a segment, ``**`` crosses segments. A pattern with
    a slash inside is anchored; one without matches a segment at any depth. A
    trailing slash stands for a directory and all below it. None for an empty
    pattern, which matches nothing.
    """
    pattern = normalized(pattern.strip())
    below = pattern.endswith("/")
    pattern = pattern.rstrip("/") if below else pattern
    if not pattern:
        return None
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(known.get(t) or re.sub(r"([.\\+^${}()|\[\]])", r"\\\1", t) for t in tokens)
    if "/" in pattern:
        return f"^{body}(?:/.*)?\\z" if below else f"^{body}\\z"
    return f"(?:^|/){body}(?:/.*)?\\z" if below else f"(?:^|/){body}(?:\\z|/)"


def matches(path: Column | str, pattern: str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else path.rlike("(?s)" + regex)


def matches_any(path: Column | str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(path, p)
    return out


def parent(path: Column | str) -> Column:
    """The directory of a path, '' at the root."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column | str) -> Column:
    """All directories above a path, the root not included."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def resolved(directory: Column, target: Column) -> Column:
    """``target`` relative to ``directory`` with dots resolved; null if it is a
    URL or leaves the repository."""
    whole = F.when(directory == "", target).otherwise(F.concat(directory, F.lit("/"), target))
    # a struct of (path so far, escaped) folded over the segments
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(
        s == "..", F.struct(F.slice(acc.p, F.lit(1), F.greatest(F.size(acc.p) - 1, F.lit(0))).alias("p"), (acc.out | (F.size(acc.p) == 0)).alias("out"))
    ).otherwise(F.struct(F.concat(acc.p, F.array(s)).alias("p"), acc.out.alias("out")))
    done = F.aggregate(F.split(F.translate(whole, "\\", "/"), "/"), start, step)
    bad = target.isNull() | target.rlike("^https?:") | done.out
    return F.when(~bad, F.array_join(done.p, "/"))
