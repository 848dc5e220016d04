"""Pinned Git revisions as tables. Only ``git`` itself runs on the driver; listings
of trees stream through it into the shared folder and are parsed by tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.lineage import place
from causeway.operators.ingest import parse_tree

BATCH_BYTES = 32 << 20
VALUE_LIMIT = (1 << 31) - 64  # fixed value: Spark holds no larger binary value


def git(root: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def streamed(spark: SparkSession, root: str, *args: str) -> DataFrame:
    """(value): the NUL-separated output of a git command, written piece by piece
    to the shared folder."""
    at = place(spark, "git")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as asked:
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        while piece := asked.stdout.read(BATCH_BYTES >> 3):
            out.write(bytearray(piece))
        out.close()
        complaint = asked.stderr.read().decode(errors="replace").strip()
    if asked.returncode:
        raise RuntimeError(f"git {args[0]}: {complaint}")
    return spark.read.schema("value string").text(at, lineSep="\0")


def resolve(root: str, ref: str) -> dict[str, str | None]:
    """Commit, first parent and tree of a ref."""
    commit, parents, tree = git(root, "show", "-s", "--format=%H%n%P%n%T", ref + "^{commit}").decode().splitlines()[:3]
    return {"commit": commit, "parent": parents.split(" ")[0] or None, "tree": tree}


def tree_entries(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """(mode, type, sha, path) of all entries below a commit's tree, directories
    included. Names are read to the NUL, so they may hold any other byte."""
    return parse_tree(streamed(spark, root, "ls-tree", "-r", "-t", "-z", "--full-tree", commit))


def blobs(entries: DataFrame, root: str) -> DataFrame:
    """(sha, size, content) of the distinct blobs of ``entries``.

    Each task asks one ``cat-file --batch`` for its share, blob by blob, and hands
    on 32 MB at a time; the repository's folder must be mounted where the tasks
    run. Only blobs of 2 GB, which no Spark value can hold, have no content.
    """

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["sha", "size", "content"]
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as asked:
            for part in parts:
                rows, held = [], 0
                for sha in part["sha"]:
                    asked.stdin.write(sha.encode() + b"\n")
                    asked.stdin.flush()
                    head = asked.stdout.readline().split()
                    if len(head) != 3:
                        raise RuntimeError(f"git has no blob {sha}")
                    n = int(head[2])
                    if rows and held + min(n, VALUE_LIMIT) > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                    if n < VALUE_LIMIT:
                        rows.append((sha, n, asked.stdout.read(n)))
                        held += n
                        asked.stdout.read(1)
                    else:
                        rows.append((sha, n, None))
                        for at in range(0, n + 1, BATCH_BYTES):
                            asked.stdout.read(min(BATCH_BYTES, n + 1 - at))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return entries.where("type = 'blob'").select("sha").distinct().mapInPandas(fetch, "sha string, size long, content binary")


def changed_paths(spark: SparkSession, root: str, base: str, target: str, merge_base: bool = False) -> DataFrame:
    """(kind, path, old_path, similarity) by Git's own rename detection."""
    names = {"A": "added", "M": "modified", "D": "deleted", "T": "type-changed", "R": "renamed"}
    if merge_base:
        base = git(root, "merge-base", base, target).decode().strip()
    fields = git(root, "diff", "--name-status", "-z", "-M", base, target).decode("utf-8", "replace").split("\0")[:-1]
    rows, at = [], 0
    while at < len(fields):
        status = fields[at]
        if status[0] == "R":
            rows.append(("renamed", fields[at + 2], fields[at + 1], int(status[1:])))
            at += 3
        else:
            rows.append((names[status[0]], fields[at + 1], None, None))
            at += 2
    out = spark.createDataFrame(rows, "kind string, path string, old_path string, similarity int")
    return out.orderBy(F.coalesce("old_path", F.lit("")), "path")
