"""Phrase collocations from vertical positional inverted lists.

Texts are dealt into blocks of about ``BLOCK_BYTES`` (a long text is cut between two
pieces, so a block is longer only where a piece is). In a block every word of every
language has a posting list, the ascending positions of its occurrences; a position
is left free between two pieces, so nothing is adjacent across a piece's end.

A level holds the lists of the phrases of k words, level by level:

1. Each block offers (phrase, length of its list). The window sum of the lengths over
   a phrase's blocks is its exact frequency; a phrase below ``min_count`` ends here. A
   phrase gets its number from the smallest (block, slot) that offers it.
2. What stays goes back to the blocks, which drop all other lists.
3. A list is extended by a merge join: where phrase P begins at s and phrase Q at s+1,
   P and Q overlap in all but one word and (P, Q) is a phrase of k+1 words that begins
   at s. A phrase can only be frequent if both are. For k = 1 these are the postings of
   the adjacent words.

The last level needs lengths only, so its lists aren't kept. One row of a shuffle is a
phrase in a block, never an occurrence: a phrase that a third of all words belong to
is one row for each block. Blocks and lists stay in the shared folder; a lost executor
costs the tasks it held.

A phrase of k words is cut after each word; the counts of its heads and tails come
along from the levels below. All arithmetic is on decimals of 38 digits, which holds
counts below 10^16. A phrase is dropped if a longer one that is frequent holds it with at
least ``within`` percent of its count; it's enough to look one word further, as what lies
between has at least the count of the longer one.

Defined cases: null text is the empty text; a null lang is ``und``; equal rows count as
often as they occur; phrases never cross a piece's or a text's end; ties are broken by
count and then by the phrase's bytes, so ranks are unique; texts of any length are read
whole; extra columns, of any name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from causeway.functions.lineage import recorded, remove, settle
from causeway.llm.common import LOWER, cut, partitions, runs, scratch, table, text_bytes

MIN_COUNT = 10
MAX_WORDS = 3
WITHIN = 50
TOP = 2000
BLOCK_BYTES = 16 << 20
_SLOT = 28  # bits of a slot in a phrase's number; partition and block of it take 22 and 13
_BLOCKS = 13
_ROWS = 1 << 16  # offers that leave a task at once
_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_LISTS = "block long, slot long, first long, rest long, n long, lang string, word binary, lists binary"


# ------------------------------------------------------------------ lists
def packed(lengths: np.ndarray, at: np.ndarray) -> bytes:
    """Posting lists, one after another, as differences; the bytes of equal weight
    stand together, so that the file's compression finds their zeros."""
    step = np.diff(at, prepend=at.dtype.type(0))
    heads = np.cumsum(lengths) - lengths
    step[heads] = at[heads]
    planes = np.ascontiguousarray(step.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return b"".join((np.int64(len(lengths)).tobytes(), lengths.astype("<u4").tobytes(), planes))


def unpacked(blob: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, positions) of ``packed``."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    lengths = np.frombuffer(blob, "<u4", n, 8).astype(np.int64)
    planes = np.frombuffer(blob, np.uint8, offset=8 + 4 * n).reshape(4, -1)
    at = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)  # a sum of all lists may wrap; the differences don't
    heads = np.cumsum(lengths) - lengths
    before = np.zeros(len(heads), np.uint32)
    before[1:] = at[heads[1:] - 1]
    at -= np.repeat(before, lengths)
    return lengths, at.view(np.int32)


def _heads(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


def _key(high: np.ndarray, low: np.ndarray, highs: int, lows: int) -> np.ndarray:
    """high * lows + low, in 32 bits where all of them fit."""
    key = high.astype(np.int32 if highs * lows < 1 << 31 else np.int64)
    key *= lows
    key += low
    return key


def postings(langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(lang, word, length, positions) of the lists of a block of texts, by lang and word.

    A block has fewer than 2^31 bytes, as an Arrow text has, so 32 bits hold its positions."""
    base = int(offsets[0])
    d = LOWER[data[base : int(offsets[-1])]]
    rel = (offsets - base).astype(np.int32)
    solid = ~_GAPS[d]
    begins = rel[:-1][rel[:-1] < len(d)]
    edge = solid.copy()
    np.greater(solid[1:], solid[:-1], out=edge[1:])
    edge[begins] = solid[begins]  # a text's first byte begins a word, whatever stands before it
    at = np.flatnonzero(edge).astype(np.int32)
    if not len(at):
        return pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int32)
    word_at = np.zeros(len(at) + 1, np.int32)
    edge[:] = solid
    np.greater(solid[:-1], solid[1:], out=edge[:-1])
    begins = begins[begins > 0] - 1
    edge[begins] = solid[begins]
    word_at[1:] = np.flatnonzero(edge)
    word_at[1:] += 1 - at
    np.cumsum(word_at, out=word_at)
    del edge
    fresh = np.zeros(len(at) + 1, bool)  # the first words of pieces and texts
    fresh[np.searchsorted(at, np.flatnonzero(_ENDS[d]).astype(np.int32))] = True
    of = np.searchsorted(at, rel)
    fresh[of] = True
    position = np.cumsum(fresh[:-1], dtype=np.int32)
    position += np.arange(len(at), dtype=np.int32)
    del at, fresh
    words = pa.Array.from_buffers(pa.binary(), len(position), [None, pa.py_buffer(word_at), pa.py_buffer(d[solid])])
    del d, solid, word_at
    words = words.dictionary_encode()
    kinds = langs.dictionary_encode()
    key = _key(np.repeat(kinds.indices.to_numpy(), np.diff(of)), words.indices.to_numpy(), len(kinds.dictionary), len(words.dictionary))
    words = words.dictionary
    order = np.argsort(key, kind="stable")
    key, position = key[order], position[order]
    del order
    heads = _heads(key)
    lang, word = np.divmod(key[heads], len(words))
    return kinds.dictionary.take(pa.array(lang)), words.take(pa.array(word)), np.diff(heads, append=len(key)).astype(np.int32), position


def extended(lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, rest, length, positions) of the lists that follow by a merge join of
    all lists with themselves, one position on; by first and rest."""
    most = max(len(lengths), 1)
    order = np.argsort(at, kind="stable")  # each position begins one phrase of a level at most
    slot = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
    at = at[order]
    del order
    hit = np.flatnonzero(np.diff(at) == 1)
    start = at[hit]
    key = _key(slot[hit], slot[1:][hit], most, most)
    del at, slot, hit
    order = np.argsort(key, kind="stable")
    key, start = key[order], start[order]
    del order
    heads = _heads(key)
    first, rest = np.divmod(key[heads], most)
    return first.astype(np.int32), rest.astype(np.int32), np.diff(heads, append=len(key)).astype(np.int32), start


def _batch(block: int, n: np.ndarray, first=None, rest=None, lang=None, word=None, blob: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """The offers of a block, ``_ROWS`` at a time, and its lists in one row that has no slot."""
    kinds = {"block": pa.int64(), "slot": pa.int64(), "first": pa.int64(), "rest": pa.int64(), "n": pa.int64(), "lang": pa.string(), "word": pa.binary(), "lists": pa.binary()}
    given = {c: v for c, v in (("n", n), ("first", first), ("rest", rest), ("lang", lang), ("word", word)) if v is not None}
    for a in range(0, len(n), _ROWS):
        m = min(_ROWS, len(n) - a)
        own = {"block": np.full(m, block), "slot": np.arange(a, a + m)} | {c: v[a : a + m] for c, v in given.items()}
        own = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in own.items()}
        yield pa.RecordBatch.from_arrays([own[c].cast(t) if c in own else pa.nulls(m, t) for c, t in kinds.items()], list(kinds))
    if blob is not None:
        yield pa.RecordBatch.from_arrays([pa.array([{"block": block, "lists": blob}.get(c)], t) for c, t in kinds.items()], list(kinds))


# ----------------------------------------------------------------- blocks
def _spans(d: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of parts of about ``most`` bytes at most; texts are cut behind a piece."""
    for row in range(len(offsets) - 1):
        a, end = int(offsets[row]), int(offsets[row + 1])
        while end - a > most:
            ends, b = np.flatnonzero(_ENDS[d[a : a + most]])[-1:], a  # the last in reach, or else the first beyond
            while not len(ends) and b + most < end:
                b += most
                ends = np.flatnonzero(_ENDS[d[b : min(b + most, end)]])[:1]
            if not len(ends):
                break
            yield row, a, b + int(ends[0]) + 1
            a = b + int(ends[0]) + 1
        yield row, a, end


def _blocks(block_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        part = TaskContext.get().partitionId()
        if part >> 63 - _SLOT - _BLOCKS:
            raise ValueError("too many partitions for the numbers of blocks")
        texts: list[np.ndarray] = []
        langs: list[str] = []
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            data = np.concatenate(texts)
            texts.clear()
            lang, word, n, at = postings(pa.array(langs, pa.string()), data, offsets)
            del data
            langs.clear()
            size = 0
            if not len(n):
                return
            if made >> _BLOCKS or len(n) >> _SLOT:
                raise ValueError("too many blocks in a partition, or words in a block")
            blob = packed(n, at)
            del at
            yield from _batch(part << _BLOCKS | made, n, lang=lang, word=word, blob=blob)
            made += 1

        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            names = b.column("lang").to_pylist()
            for row, start, end in _spans(data, offsets, block_bytes):
                if size and size + end - start > block_bytes:
                    yield from closed()
                texts.append(data[start:end].copy())
                langs.append(names[row])
                size += end - start
        if size:
            yield from closed()

    return scan


def _extend(keep_lists: bool):
    """Of each block: its lists, and the (slot, number) of those that are frequent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block"]):
            block, slot = (t.column(c).to_numpy() for c in ("block", "slot"))
            number = t.column("id").fill_null(-1).to_numpy()  # a null would make them doubles, which round numbers beyond 2^53
            lists = t.column("lists")
            del t
            heads = np.flatnonzero(slot < 0)
            for a, b in zip(heads, [*heads[1:], len(slot)]):
                lengths, at = unpacked(lists[int(a)].as_buffer())
                kept, ids = slot[a + 1 : b], number[a + 1 : b]
                frequent = np.zeros(len(lengths), bool)
                frequent[kept] = True
                at, lengths = at[np.repeat(frequent, lengths)], lengths[kept]
                first, rest, n, at = extended(lengths, at)
                if len(n) >> _SLOT:
                    raise ValueError("too many phrases in a block")
                if len(n):
                    blob = packed(n, at) if keep_lists else None
                    del at
                    yield from _batch(int(block[a]), n, first=ids[first], rest=ids[rest], blob=blob)

    return scan


def _frequent(level: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """The offers (own = block and slot) of ``level`` whose phrase has ``min_count``
    occurrences; a = that frequency, id = the phrase's number, its smallest ``own``."""
    w = W.partitionBy(*key)
    own = F.shiftleft("block", _SLOT).bitwiseOR(F.col("slot")).alias("own")
    offers = level.where("slot is not null").select("n", own, *key)
    return offers.withColumn("a", F.sum("n").over(w)).where(F.col("a") >= min_count).withColumn("id", F.min("own").over(w)).drop("n")


def mined(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), levels): the number of words of each language, and for each level
    from the words on (id, lang, phrase, tail, a, first, rest, heads, tails) of its frequent
    phrases; heads and tails are the counts of what a cut after each word gives."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    with scratch(spark) as kept_scope:
        with recorded() as behind:
            level = cut(text.mapInArrow(_blocks(block_bytes), _LISTS), "postings")
        totals = kept_scope.keep(level.where("slot is not null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        none = F.array().cast("array<long>")
        levels: list[DataFrame] = []
        for k in range(1, max_words + 1):
            key = ["lang", "word"] if k == 1 else ["first", "rest"]
            if k == max_words:  # lengths are all that's left to do
                found = level.groupBy(*key).agg(F.sum("n").alias("a")).where(F.col("a") >= min_count).withColumn("id", F.lit(None).cast("long"))
            else:
                with recorded() as more:
                    kept = cut(_frequent(level, key, min_count), "frequent")
                behind += more
                found = kept.where("own = id").select("id", "a", *key)
            if k == 1:
                word = F.col("word").cast("string")
                named = found.select("id", "lang", word.alias("phrase"), word.alias("tail"), "a", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("rest"), none.alias("heads"), none.alias("tails"))
            else:
                p, q = (levels[-1].select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "lang", "phrase", "tail", "a", "heads", "tails")]) for x in "pq")
                named = found.join(p, F.col("first") == F.col("p_id")).join(q, F.col("rest") == F.col("q_id")).select(
                    "id", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "q_tail").alias("phrase"), F.col("q_tail").alias("tail"), "a", "first", "rest",
                    F.concat("p_heads", F.array("p_a")).alias("heads"), F.concat(F.array("q_a"), "q_tails").alias("tails"),
                )
            levels.append(kept_scope.keep(named, "phrases"))
            if k < max_words:
                lists = level.where("slot is null").select("block", F.lit(-1).cast("long").alias("slot"), F.lit(None).cast("long").alias("id"), "lists")
                of = kept.select(F.shiftright("own", _SLOT).alias("block"), F.col("own").bitwiseAND((1 << _SLOT) - 1).alias("slot"), "id", F.lit(None).cast("binary").alias("lists"))
                level = lists.unionByName(of).repartition("block").sortWithinPartitions("block", "slot").mapInArrow(_extend(k + 1 < max_words), _LISTS)
                if k + 1 < max_words:
                    with recorded() as more:
                        level = cut(level, "lists")
                    remove(spark, behind)
                    settle(spark)
                    behind = more
        remove(spark, behind)
    return totals, levels


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, within: int = WITHIN, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    spark = docs.sparkSession
    with scratch(spark) as own_scope:
        totals, levels = mined(docs, min_count, max_words, block_bytes)
        kept: DataFrame | None = None
        for k in range(1, max_words):
            own = levels[k]
            if k + 1 < max_words:
                longer = levels[k + 1]
                inside = longer.select(F.col("first").alias("id"), "a").unionByName(longer.select(F.col("rest").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("held"))
                own = own.join(inside, "id", "left").where(F.coalesce(100 * F.col("held") < within * F.col("a"), F.lit(True)))
            own = own.select("lang", "phrase", "a", "heads", "tails")
            kept = own if kept is None else kept.unionByName(own)
        whole = "decimal(38,0)"
        square = f"cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as {whole}) * 1000000"
        cuts = F.expr(f"transform(heads, (l, i) -> named_struct('score', cast({square} as {whole}) div (cast(l as decimal(19,0)) * cast(tails[i] as decimal(19,0))), 'k', i, 'l', l, 'r', tails[i]))")
        best = kept.withColumn("best", F.array_min(cuts)).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        for parts in sorted({partitions(spark), 8, 1}, reverse=True):  # the first of each part, then the first of those
            w = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
            best = best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
        return own_scope.keep(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = """
WITH p AS (
  SELECT d, lang, unnest(range(len(s))) AS i, unnest(s) AS x FROM (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS s
    FROM documents)),
w AS (SELECT d, lang, i, unnest(range(len(s))) AS j, unnest(s) AS w FROM (SELECT d, lang, i, regexp_extract_all(x, '[^\\x20\\x09]+') AS s FROM p)),
o AS (SELECT lang, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY d, i ORDER BY j)),
f1 AS (SELECT lang, w, count(*)::HUGEINT AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w, w2, count(*)::HUGEINT AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w, w2, w3, count(*)::HUGEINT AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c3 AS (
  SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2
  FROM f3 c JOIN f1 a1 ON a1.lang = c.lang AND a1.w = c.w JOIN f2 b1 ON b1.lang = c.lang AND b1.w = c.w2 AND b1.w2 = c.w3
    JOIN f2 a2 ON a2.lang = c.lang AND a2.w = c.w AND a2.w2 = c.w2 JOIN f1 b2 ON b2.lang = c.lang AND b2.w = c.w3),
s3 AS (SELECT *, 1000000 * a * a // (l1 * r1) AS v1, 1000000 * a * a // (l2 * r2) AS v2 FROM c3),
h AS (SELECT lang, w, w2, max(f) AS held FROM (SELECT lang, w, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
r AS (
  SELECT lang, phrase, a, CASE WHEN v1 <= v2 THEN l1 ELSE l2 END AS l, CASE WHEN v1 <= v2 THEN r1 ELSE r2 END AS r, least(v1, v2) AS score FROM s3
  UNION ALL
  SELECT c.lang, c.w || ' ' || c.w2, c.f, x.f, y.f, 1000000 * c.f * c.f // (x.f * y.f)
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w = c.w JOIN f1 y ON y.lang = c.lang AND y.w = c.w2
    LEFT JOIN h ON h.lang = c.lang AND h.w = c.w AND h.w2 = c.w2
  WHERE c.f >= 10 AND (h.held IS NULL OR 100 * h.held < 50 * c.f))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r JOIN n USING (lang)) WHERE rank <= 2000
"""
