"""Helpers shared by the operators: numpy views of Arrow text, word hashing, streamed groups and connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.lineage import cut, scratch, shared_dir  # noqa: F401 - the operators take them from here

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as the struct ``row``, so that no name of an
    operator meets one of its columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------- Arrow text
def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; one long row is a run by itself."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x = x ^ (x >> U64(28))
    return x * U64(0xD6E8FEB86659FD93) ^ (x >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _pow["n"]:
        for key, step in (("up", _STEP), ("down", _BACK)):
            p = np.full(n, step, U64)
            p[0] = 1
            _pow[key] = np.cumprod(p, dtype=U64)
        _pow["n"] = n
    return _pow["up"][:n], _pow["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.

    The 64-bit hash is polynomial, so one cumulative sum serves all words.
    """
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    d = data[base : base + n]
    rel = offsets - base
    solid = ~SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    up, down = _powers(n + 1)
    run = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[LOWER[d]] * up[:n], out=run[1:])
    h = mix((run[end] - run[start]) * down[start] + (end - start).astype(U64))
    row = np.searchsorted(rel, start, "right") - 1
    return row, start + base, end + base, h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes for each row.

    Fewer than ``k`` words count as one shingle; no words give an empty set.
    """
    for a, b in chunks(offsets):
        row, _, _, h = words(data, offsets[a : b + 1])
        at = np.searchsorted(row, np.arange(b - a + 1))
        grams = np.zeros(0, U64)
        if len(h) >= k:
            grams = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                grams = mix(grams) + h[i : len(h) - k + 1 + i]
            grams = mix(grams + U64(k))
        for i in range(b - a):
            x, y = int(at[i]), int(at[i + 1])
            if y - x >= k:
                yield np.unique(grams[x : y - k + 1])
            elif y > x:
                g = h[x : x + 1].copy()
                for w in h[x + 1 : y]:
                    g = mix(g) + w
                yield mix(g + U64(y - x))
            else:
                yield grams[:0]


# ---------------------------------------------------------- sorted groups
def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the integer ``keys``.

    A yielded table holds one or more complete groups; only the last, still
    open group is carried over to the next batch.
    """
    held: list[pa.RecordBatch] = []

    def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
        return all(x.column(k)[i].as_py() == y.column(k)[j].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if same(b, 0, b, b.num_rows - 1):
            if held and not same(held[-1], held[-1].num_rows - 1, b, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        changed = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            changed |= v[1:] != v[:-1]
        last = int(np.flatnonzero(changed)[-1]) + 1
        yield pa.Table.from_batches([*held, b.slice(0, last)]) if held else pa.Table.from_batches([b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table of ``runs`` begin, and its length."""
    changed = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        v = t.column(k).to_numpy()
        changed |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [t.num_rows]])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes linked by (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


# ------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected links (a, b) of longs.

    Each round hooks every node to its smallest neighbour, shortcuts the
    pointers by doubling until they are stable, and contracts the links. Links
    and pointers stay in the shared folder; nothing goes to the driver but
    counts. A hub is a hot key only in plain joins, which adaptive execution
    splits.
    """
    spark = edges.sparkSession
    with scratch(spark) as own_scope:
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        done: DataFrame | None = None
        while edges.head(1):
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
            parent = cut(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")), "parents")
            while True:
                up = parent.select(F.col("node").alias("component"), F.col("component").alias("top"))
                parent = cut(parent.join(up, "component").select("node", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")), "parents")
                if not parent.where("moved").head(1):
                    break
                parent = parent.drop("moved")
            parent = parent.drop("moved")
            pa_, pb = (parent.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            edges = cut(edges.join(pa_, "a").join(pb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
            if done is None:
                done = parent
            else:
                later = parent.select(F.col("node").alias("component"), F.col("component").alias("top"))
                done = cut(done.join(later, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
        return own_scope.keep(done if done is not None else spark.createDataFrame([], "node long, component long"), "components")
