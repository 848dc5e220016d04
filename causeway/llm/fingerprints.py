"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text wherever its low bits are all ones,
so cuts depend on the local context only. Each piece becomes one of 64
characters. A fingerprint is ``size:signature:signature at twice the size``; the
block size is a power of two that yields about 32 to 64 pieces. Two
fingerprints are compared at a common block size by the edit distance (insert
and delete) of their signatures, provided they share a run of ``RUN``
characters: ``1 - distance / (length + length)``.

Defined cases: null and empty texts have the fingerprint of the empty text, and
equal texts have equal fingerprints (likeness 1); texts of any length are read
whole; rows with equal doc_ids follow each other in the order of a hash of
their texts (equal rows in any order); null doc_ids come last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm.common import U64, cut, mix, table, _BYTE, _powers

WINDOW = 7
SMALLEST = 4
MOST = 64
RUN = 4
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(ends: np.ndarray, run: np.ndarray, start: int, stop: int) -> str:
    """A character for each piece of [start, stop) that ``ends`` cut."""
    edge = np.concatenate([[start], ends, [stop]]) if not len(ends) or ends[-1] < stop else np.concatenate([[start], ends])
    a, b = edge[:-1], edge[1:]
    _, down = _powers(len(run))
    h = mix((run[b] - run[a]) * down[a])
    return _CHARS[(h >> U64(58)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    at, n = 0, len(texts)
    while at < n:
        size, end = 0, at
        while end < n and (end == at or size + len(texts[end]) <= 1 << 20):
            size += len(texts[end])
            end += 1
        out += _fingerprints(texts[at:end])
        at = end
    return out


def _fingerprints(texts: list[bytes]) -> list[str]:
    d = np.frombuffer(b"".join(texts), np.uint8)
    v = _BYTE[d]
    up, _ = _powers(len(d) + 1)
    run = np.zeros(len(d) + 1, U64)
    np.cumsum(v * up[: len(d)], out=run[1:])
    low = v.astype(np.uint32)
    roll, scale = low.copy(), 1
    for k in range(1, WINDOW):
        scale = scale * 0x2C9277B5 % (1 << 32)
        roll[k:] += low[:-k] * np.uint32(scale)
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    out, a = [], 0
    for t in texts:
        b = a + len(t)
        own = roll[a + WINDOW - 1 : b]  # whole windows inside the text
        size = SMALLEST
        while size * MOST < len(t):
            size *= 2

        def ends(size: int) -> np.ndarray:
            return np.flatnonzero((own & np.uint32(size - 1)) == size - 1) + (a + WINDOW)

        one = ends(size)
        while len(one) > 2 * MOST:
            size *= 2
            one = ends(size)
        while len(one) < MOST // 2 and size > SMALLEST:
            more = ends(size // 2)
            if len(more) > 2 * MOST:
                break
            size, one = size // 2, more
        out.append(f"{size}:{_signature(one, run, a, b)}:{_signature(ends(2 * size), run, a, b)}")
        a = b
    return out


def _same(x: str, y: str) -> float:
    """Likeness of two signatures by their longest common subsequence."""
    if x == y:
        return 1.0
    k = min(RUN, len(x), len(y))
    if {x[i : i + k] for i in range(len(x) - k + 1)}.isdisjoint([y[i : i + k] for i in range(len(y) - k + 1)]):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 where the block sizes have nothing in common."""
    if x == y:
        return 1.0
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    if a == b:
        return max(_same(a1, b1), _same(a2, b2))
    if int(a) == 2 * int(b):
        return _same(a1, b2)
    if 2 * int(a) == int(b):
        return _same(a2, b1)
    return 0.0


# -------------------------------------------------------------- the query
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], prints: list[str], after: list[tuple[str, str]]) -> pa.RecordBatch:
    """Results of documents, given the (text, fingerprint) that follows each."""
    edited = []
    for t, (nxt, _) in zip(texts, after):
        m = len(t) // 3
        edited.append((t[: len(t) - m] + nxt[:m]).encode("utf-8", "surrogatepass"))
    prints2 = fingerprints(edited)
    cols = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(prints, pa.string()), pa.array(prints2, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, prints2)], pa.float64()), pa.array([likeness(a, b) for a, (_, b) in zip(prints, after)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents: all but the partition's last have their follower at
    hand. The first and the last row also leave as an edge of the partition."""
    part, held = TaskContext.get().partitionId(), None
    empty = pa.RecordBatch.from_pylist([], pa.schema([("edge", pa.int64()), ("part", pa.int64()), ("text", pa.string())]))

    def tagged(rows: pa.RecordBatch, edge: int, text: str | None) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([edge] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([text] * n, pa.string())], [*rows.schema.names, *empty.schema.names])

    def edge(row: tuple, kind: int) -> pa.RecordBatch:
        return tagged(_rows([row[0]], [row[1]], [row[2]], [("", row[2])]), kind, row[1])

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
            rows = list(zip(ids, texts, prints))
            if held is None:
                yield edge(rows[0], 1)
            else:
                rows.insert(0, held)
            held = rows.pop()
            if rows:
                follow = [(t, p) for _, t, p in rows[1:]] + [held[1:]]
                yield tagged(_rows(*map(list, zip(*rows)), follow), 0, None)
    if held is not None:
        yield edge(held, 2)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            follow = list(zip(b.column("next_text").to_pylist(), b.column("next_print").to_pylist()))
            yield _rows(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("fingerprint").to_pylist(), follow)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The text is range-partitioned by descending doc_id once; a document's
    follower is the next row. Only one row for each partition needs the first row
    of the next, found by a join of these edges.
    """
    spark = docs.sparkSession
    # rows of one doc_id, or of none, are dealt over ranges too
    order = [F.col("doc_id").desc_nulls_last(), "hash", "tie"]
    lined = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    lined = lined.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = cut(lined.mapInArrow(_scan, f"{_OUT}, edge long, part long, text string"), "fingerprints")
    heads = found.where("edge = 1")
    parts = sorted(r.part for r in heads.select("part").collect())  # one for each partition with rows
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    tails = found.where("edge = 2").join(follow, "part")
    heads = heads.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = tails.join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_close, _OUT)
    return found.where("edge = 0").select(*last.columns).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
