"""Line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of white space and lower-cased (A-Z). Keys
of at least ``MIN_CHARS`` code points that stand in two or more documents lose
all their lines but those of the smallest doc_id.

1. Each document yields its distinct key hashes (128 bits), which are written
   once; they are aggregated before the shuffle to count, smallest and largest
   doc_id.
2. Hashes found in two documents or more go to shards by hash. A shard becomes
   a minimal perfect hash (levels of bit arrays) that indexes compact arrays: a
   64-bit fingerprint, the count and the owner. Keys of one document can't lose
   a line, so they need no slot; the fingerprint turns them away.
3. Documents probe first a small copy of the arrays, with fingerprints of one
   byte (about two bytes a key), where their lines are: lines that aren't repeated
   go no further. The copy goes to every task, so it is made for ``SMALL_KEYS`` keys
   at most; beyond these all lines pass. What passes is sent to the shards and
   probes the whole arrays; only hits that the document doesn't own come back,
   grouped by document.
4. The text of documents with hits is rebuilt.

A line of very many documents would make its shard's probes hot. Shards that
hold one are copied and the documents spread over the copies; a line counts as
hot beyond half of a mean partition's probes, so there are at most two of them
for each partition, and their list is small.

Defined cases: null or empty text is one empty line; null doc_ids count as one
document larger than all others; rows with equal doc_ids count as one document
(their own repeated lines stay); ``\\r`` is white space at a line's end; texts of
any length are read whole; ties can't occur (a key has one smallest doc_id);
extra columns, of any name, are kept by ``dedup_lines``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from causeway.llm.common import U64, bounds, cut, mix, partitions, runs, scratch, table, text_bytes, wrapped

MIN_CHARS = 10
SHARD_KEYS = 16384
SMALL_KEYS = 1 << 22
PROBED = 200_000
_BLANK = b" \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The key's 16-byte hash, or None for a short key."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the distinct key hashes of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # few texts at a time: their copies are short-lived
                batch = whole.slice(at, 512)
                data, offs = text_bytes(batch.column("text"))
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                raw = data[offs[0] : offs[-1]].tobytes().lower()
                offs = offs - offs[0]
                found, of = [], []
                for i in range(len(ids)):
                    own = {line_hash(x, min_chars) for x in raw[offs[i] : offs[i + 1]].split(b"\n")}
                    own.discard(None)
                    found += own
                    of.append(len(own))
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, of)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc", "h1", "h2"])

    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text").mapInArrow(scan, "doc long, h1 long, h2 long")


# --------------------------------------------------- minimal perfect hash
def mph_build(keys: np.ndarray, room: float = 1.5) -> list[np.ndarray]:
    """Levels of booleans; a key sits at the first level where it is alone."""
    levels: list[np.ndarray] = []
    while len(keys):
        size = max(8, int(len(keys) * room))
        at = _slot(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
        if len(levels) > 200:
            raise ValueError("equal keys")
    return levels


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U64(0xA24BAED4963EE407 * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)


def mph_index(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's place among the members; -1 if no level has it."""
    out, base = np.full(len(keys), -1, np.int64), 0
    open_ = np.arange(len(keys))
    for k, alone in enumerate(levels):
        at = _slot(keys[open_], k, len(alone))
        hit = alone[at]
        rank = np.cumsum(alone)
        out[open_[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


def _shard_blob(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, owner: np.ndarray) -> bytes:
    keys = h1.view(U64)
    levels = mph_build(keys)
    at = mph_index(levels, keys)
    order = np.argsort(at)
    head = np.array([len(levels), len(keys), *(len(x) for x in levels)], "<i8")
    bits = b"".join(np.packbits(x).tobytes() for x in levels)
    return b"".join([head.tobytes(), h2[order].tobytes(), owner[order].tobytes(), np.minimum(count[order], 0xFFFFFFFF).astype("<u4").tobytes(), bits])


class Small:
    """The places of a shard's keys with a fingerprint of one byte."""

    def __init__(self, blob: bytes):
        self.levels, fp, _, _ = _shard_load(blob)
        self.fp = fp.astype(np.uint8)

    def __getstate__(self):
        return [(len(x), np.packbits(x)) for x in self.levels], self.fp

    def __setstate__(self, state):
        packed, self.fp = state
        self.levels = [np.unpackbits(x, count=n).astype(bool) for n, x in packed]

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = mph_index(self.levels, h1.view(U64))
        return (at >= 0) & (self.fp[at] == h2.astype(np.uint8))


def _pass(shared):
    """The lines that the small arrays may hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def probed(held: list[pa.RecordBatch]) -> pa.Table:
            t = pa.Table.from_batches(held)
            shard, h1, h2 = (t.column(c).to_numpy() for c in ("shard", "h1", "h2"))
            order = np.argsort(shard, kind="stable")
            kinds, at = np.unique(shard[order], return_index=True)
            ok = np.zeros(len(shard), bool)
            for k, a, b in zip(kinds, at, [*at[1:], len(shard)]):
                for small in shared.value.get(int(k), ()):
                    own = order[a:b]
                    ok[own] |= small.may_hold(h1[own], h2[own])
            return t.filter(pa.array(ok))

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PROBED:
                yield from probed(held).to_batches()
                held, n = [], 0
        if held:
            yield from probed(held).to_batches()

    return scan


def _shard_load(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    n_levels, n = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    sizes = np.frombuffer(blob, "<i8", n_levels, 16)
    at = 16 + 8 * n_levels
    h2, owner = np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, "<i8", n, at + 8 * n)
    count = np.frombuffer(blob, "<u4", n, at + 16 * n)
    at += 20 * n
    levels = []
    for s in map(int, sizes):
        w = -(-s // 8)
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, w, at), count=s).astype(bool))
        at += w
    return levels, h2, owner, count


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["shard"]):
        cols = {c: t.column(c).to_numpy() for c in ("shard", "h1", "h2", "n", "owner")}
        cut_at = bounds(t, ["shard"])
        for a, b in zip(cut_at, cut_at[1:]):
            # the first 64 bits place a key; should two keys share them, the second sits in a further array
            h1, h2, n, owner = (cols[c][a:b] for c in ("h1", "h2", "n", "owner"))
            while len(h1):
                _, first = np.unique(h1, return_index=True)
                blob = _shard_blob(h1[first], h2[first], n[first], owner[first])
                yield pa.RecordBatch.from_arrays([pa.array([int(cols["shard"][a])], pa.int64()), pa.array([blob], pa.binary())], ["shard", "blob"])
                rest = np.setdiff1d(np.arange(len(h1)), first)
                h1, h2, n, owner = h1[rest], h2[rest], n[rest], owner[rest]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["shard", "salt"]):
        h1, h2, doc = (t.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        is_line = t.column("line").to_numpy()
        cut_at = bounds(t, ["shard", "salt"])
        for a, b in zip(cut_at, cut_at[1:]):
            k = a + int((is_line[a:b] == 0).sum())
            q1, q2, d = h1[k:b], h2[k:b], doc[k:b]
            for j in range(a, k):
                levels, fp, owner, _ = _shard_load(t.column("blob")[j].as_py())
                at = mph_index(levels, q1.view(U64))
                hit = at >= 0
                hit[hit] = (fp[at[hit]] == q2[hit]) & (owner[at[hit]] != d[hit])
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(q1[hit]), pa.array(q2[hit])], ["doc", "h1", "h2"])


def small_arrays(arrays: DataFrame) -> dict[int, list[Small]]:
    """The small copy of all shards; its keys have been counted."""
    out: dict[int, list[Small]] = {}
    for r in arrays.select("shard", "blob").toLocalIterator():
        out.setdefault(r.shard, []).append(Small(bytes(r.blob)))
    return out


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, small_keys: int = SMALL_KEYS) -> DataFrame:
    """(doc, gone): for each document that loses lines, their key hashes."""
    spark = docs.sparkSession
    with scratch(spark) as own_scope:
        lines = cut(line_hashes(docs, min_chars), "lines")
        seen = Observation()
        keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n"))
        keys = cut(keys.observe(seen, F.sum("n").alias("all")).where("owner < last").drop("last"), "repeated")
        n, width = keys.count(), partitions(spark)
        n_shards = max(8 * width, -(-n // SHARD_KEYS))
        shard = F.pmod(F.xxhash64("h1"), F.lit(n_shards))
        hot = max(1024, (seen.get["all"] or 0) // (2 * width))
        spread = cut(keys.where(F.col("n") > hot).groupBy(shard.alias("shard")).agg(F.ceil(F.max("n") / hot).alias("copies")), "hot")
        copies = F.coalesce("copies", F.lit(1).cast("long"))
        arrays = cut(keys.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, "shard long, blob binary"), "arrays")
        lines = lines.withColumn("shard", shard)
        if n <= small_keys:
            lines = lines.mapInArrow(_pass(spark.sparkContext.broadcast(small_arrays(arrays))), "doc long, h1 long, h2 long, shard long")
        none = F.lit(0).cast("long")
        arrays = arrays.join(F.broadcast(spread), "shard", "left").withColumn("salt", F.explode(F.sequence(none, copies - 1))).select("shard", "salt", none.alias("line"), none.alias("h1"), none.alias("h2"), none.alias("doc"), "blob")
        lines = lines.join(F.broadcast(spread), "shard", "left")
        lines = lines.select("shard", F.pmod(F.xxhash64("doc"), copies).alias("salt"), F.lit(1).cast("long").alias("line"), "h1", "h2", "doc", F.lit(None).cast("binary").alias("blob"))
        hits = arrays.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "line").mapInArrow(_probe, "doc long, h1 long, h2 long")
        return own_scope.keep(hits.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone")), "gone")


def _rebuild(min_chars: int):
    @F.pandas_udf("text string, n_dropped long")
    def rebuild(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for x, hs in zip(text, gone):
            if x is None or hs is None:
                out.append(None)
                n.append(0)
                continue
            bad = {np.array([h["h1"], h["h2"]], "<i8").tobytes() for h in hs}
            raw = x.encode("utf-8", "surrogatepass").split(b"\n")
            kept = [y for y in raw if line_hash(y.lower(), min_chars) not in bad]
            out.append(b"\n".join(kept).decode("utf-8", "replace"))
            n.append(len(raw) - len(kept))
        return pd.DataFrame({"text": out, "n_dropped": n})

    return rebuild


def rebuilt(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of ``docs`` as a struct, with its
    new text. A document that loses nothing keeps its text as it is, null included."""
    gone = drops(docs, min_chars)
    joined = wrapped(docs).withColumn("doc", F.coalesce("row.doc_id", F.lit(_LAST))).join(gone, "doc", "left")
    new = _rebuild(min_chars)(F.when(F.col("gone").isNotNull(), F.col("row.text")), "gone")
    lines = F.regexp_count(F.coalesce("row.text", F.lit("")), F.lit("\n")) + 1
    out = joined.withColumn("new", new)
    return out.select("row", F.coalesce("new.text", "row.text").alias("text"), lines.cast("long").alias("n_lines"), F.coalesce("new.n_dropped", F.lit(0)).alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the new texts, the same columns; a column ``n_chars`` follows
    the text."""
    out = rebuilt(docs, min_chars)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("long"), F.col("row.n_chars").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rebuilt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, i, x, regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
r AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (
  SELECT l.doc_id, l.i, l.x, r.owner IS NOT NULL AND r.owner <> l.doc_id AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
