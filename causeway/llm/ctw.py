"""Language-model scoring by context-tree weighting over bytes.

A text is the sequence of its lower-cased words, each followed by a boundary
byte, and one end byte. Each byte is decomposed into eight binary decisions. A
decision's context is the ``DEPTH`` bytes before it, across words, back to the
text's start (an end byte stands before it), and the tree of contexts mixes the
Krichevsky-Trofimov estimates of all depths with the weights of context-tree
weighting: ``P_w = P_kt / 2 + prod(children's P_w) / 2``. Code lengths come from
the posterior mixture over the contexts with observations; a text's score is the
sum of its bytes' log-probabilities, that of the whole sequence.

A gram is a byte with its context, packed in a long with the nearest byte of the
context first, so contexts that share their nearest bytes are neighbours.

1. One scan counts words (by hash) and grams in each task, and one aggregate
   over the corpus. Grams of held-out texts take part with count 0, so that each
   byte to be scored has its place.
2. Grams are dealt by the ``TOP`` nearest bytes of their contexts, those of a
   context with more than ``GROUP`` grams by one byte more, and so on, so that no
   group grows with the corpus. Each group is a subtree and goes up to its root in
   a task; the levels above are aggregates and joins; a second pass over the
   groups comes down. The depth is the same at every size of input, the values
   don't depend on ``GROUP``, and the tree stays distributed.
3. Documents sum the values of their grams and words: the most frequent ones, at
   most ``COMMON_GRAMS`` and ``COMMON`` (chosen by a threshold on their count), are
   looked up in the task, all others by a join.

The base is an add-one unigram model over words and one end for each text.

Defined cases: null and empty texts are one end token; repeated rows are scored
each by itself and ties need no order; rows with a null doc_id are training
documents; texts and words of any length are coded byte by byte; without
training documents every estimate is that of empty counts; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causeway.llm.common import LOWER, SPACE, U64, bounds, chunks, cut, runs, scratch, table, text_bytes, words

DEPTH = 6
TOP = 3
GROUP = 1 << 18  # grams of one subtree in a task
COMMON_GRAMS = 1 << 21
COMMON = 1 << 17
HELD = 1 << 22  # counts that a task holds, 12 bytes each
BOUNDARY, END = 0x20, 0x0A  # neither is part of a word
LOG2 = math.log(2)
WORD, GRAM = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


# --------------------------------------------------------------- sequences
def sequences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the coded sequences of texts."""
    base, n = int(offs[0]), int(offs[-1] - offs[0])
    rel = offs - base
    d = LOWER[data[base : base + n]]
    solid = ~SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    last = solid & edge[1:]
    last[:-1] |= solid[:-1] & ~solid[1:]
    upto = np.concatenate([[0], np.cumsum(solid.astype(np.int64) + last)])
    out = upto[rel] + np.arange(len(rel))
    flat = np.full(int(out[-1]), BOUNDARY, np.uint8)
    row = np.repeat(np.arange(len(rel) - 1), np.diff(rel))
    flat[(upto[:-1] + row)[solid]] = d[solid]
    flat[out[1:] - 1] = END
    return flat, out


def grams_of(flat: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it, the nearest one highest."""
    key = flat.astype(np.int64)
    wide = key.copy()
    for k in range(1, depth + 1):
        key[k:] |= wide[:-k] << 8 * (depth - k + 1)
    for j in range(depth):  # before a text's start stand end bytes
        at = offs[:-1] + j
        at = at[at < offs[1:]]
        real = (1 << 8 * (depth + 1)) - (1 << 8 * (depth - j + 1)) | 0xFF
        key[at] = key[at] & real | sum(END << 8 * (depth - k + 1) for k in range(j + 1, depth + 1))
    return key


# ---------------------------------------------------------------- counting
def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their ``n``."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[start], np.add.reduceat(n, start, dtype=np.int64) if len(start) else n.astype(np.int64)


class Tally:
    """Counts of keys, held until ``HELD`` of them stay distinct."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts ``key``; what is held, if it is time to pass it on."""
        key, n = np.unique(key, return_counts=True)
        self.parts.append((key, n.astype(np.int32)))
        self.size += len(key)
        if self.size > HELD:
            key, n = self.take()
            if len(key) > 3 * HELD // 4:
                return key, n
            self.parts, self.size = [(key, n.astype(np.int32))], len(key)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        return summed(key, n)


def _counts(depth: int):
    """Words and grams of a task's texts, with their counts in all and in training."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, trained: bool, keys: np.ndarray, ns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                key, n = keys[k : k + 100_000], ns[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key), pa.array(n), pa.array(n if trained else np.zeros_like(n))], ["kind", "key", "n", "c"])

        tallies = {(kind, trained): Tally() for kind in (WORD, GRAM) for trained in (True, False)}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                some = whole.slice(k, 512)
                for trained in (True, False):
                    batch = some.filter(some.column("train") if trained else pc.invert(some.column("train")))
                    data, offs = text_bytes(batch.column("text"))
                    for a, b in chunks(offs):
                        own = offs[a : b + 1]
                        end = np.zeros(b - a, np.int64)  # the end token
                        for kind, key in ((WORD, np.concatenate([words(data, own)[3].view(np.int64), end])), (GRAM, grams_of(*sequences(data, own), depth))):
                            if ready := tallies[kind, trained].add(key):
                                yield from rows(kind, trained, *ready)
        for (kind, trained), tally in tallies.items():
            yield from rows(kind, trained, *tally.take())

    return scan


# -------------------------------------------------------------------- tree
# A node of depth d is a context of d bytes and a position 1-255 in the byte's
# binary tree; its key is ``context << 8 | position``.
def log_kt_array(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of blocks of bits."""

    def log_gamma(x: np.ndarray) -> np.ndarray:  # Stirling's series at x + 6
        y = x + 6
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))

    seen = zeros + ones
    return np.where(seen == 0, 0.0, log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(seen + 1.0))


def log_kt(zeros: Column, ones: Column) -> Column:
    """The same as a column."""

    def log_gamma(x: Column) -> Column:
        y = x + 6
        series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3)))
        return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))

    return F.when(zeros + ones == 0, 0.0).otherwise(log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0))


class Level:
    """The nodes of one depth at one of the eight bits, in order of their keys."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, bit: int):
        start = np.flatnonzero(np.concatenate([[True], gram[1:] >> (8 - bit) != gram[:-1] >> (8 - bit)]))
        byte = gram[start] & 255
        self.key = gram[start] >> 8 << 8 | (byte | 256) >> (8 - bit)
        ones = np.add.reduceat(n * (gram >> (7 - bit) & 1), start).astype(float)
        self.n1, self.n0 = ones, np.add.reduceat(n, start) - ones
        self.start, self.size = start, len(gram)
        self.kt = log_kt_array(self.n0, self.n1)
        self.below: np.ndarray | None = None

    def weighted(self) -> np.ndarray:
        if self.below is None:
            return self.kt
        return np.logaddexp(self.kt, self.below) - LOG2

    def under(self, parents: np.ndarray) -> np.ndarray:
        """Each node's parent among the sorted keys of the depth above."""
        return np.searchsorted(parents, self.key >> 16 << 8 | self.key & 255)

    def of_grams(self) -> np.ndarray:
        """The node of each gram that the level was made from."""
        return np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, self.size)))


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[list[Level]]:
    """Levels of the depths ``depth`` down to ``top`` (in this order), eight bits
    each, of whole subtrees given by their sorted grams."""
    out: list[list[Level]] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            shorter = gram >> 16 << 8 | gram & 255
            order = np.argsort(shorter, kind="stable")
            shorter = shorter[order]
            start = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
            gram, n = shorter[start], np.add.reduceat(n[order], start)
        levels = [Level(gram, n, bit) for bit in range(8)]
        if d < depth:
            for low, up in zip(out[-1], levels):
                up.below = np.bincount(low.under(up.key), weights=low.weighted(), minlength=len(up.key))
        out.append(levels)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole groups of rows sorted by (top, ctx), with the bytes that they share."""
    for t in runs(batches, ["top", "ctx"]):
        cuts = bounds(t, ["top"])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield t.column("top")[int(a)].as_py(), t.slice(a, b - a)


def _roots(depth: int):
    """Up: the root of each group, with counts and the log of its children's weight."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, t in _groups(batches):
            for x in subtrees(t.column("key").to_numpy(), t.column("c").to_numpy(), depth, top)[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.key), top, np.int32)), pa.array(x.key >> 8), pa.array(x.key & 255), pa.array(x.n0), pa.array(x.n1), pa.array(x.below)], ["top", "ctx", "node", "n0", "n1", "below"])

    return scan


def _shares(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior weights of a node's own estimate and of its children."""
    gap = np.clip(below - kt, -700, 700)
    return 1 / (1 + np.exp(gap)), 1 / (1 + np.exp(-gap))


def _down(depth: int):
    """log10 of each gram, given what comes from the root of its group: the
    probability of bit i is ai + b * (that at the node), or qi where the node has
    no observations. Both bits have their own sums, since 1 - p of a p near 1 has
    no digits left."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, t in _groups(batches):
            is_gram = t.column("kind").to_numpy() == GRAM
            gram, roots = t.filter(pa.array(is_gram)), t.filter(pa.array(~is_gram))
            keys, m = gram.column("key").to_numpy(), gram.column("n").to_numpy()
            levels = subtrees(keys, gram.column("c").to_numpy(), depth, top + 1)[::-1]
            names = ("a0", "a1", "b", "q0", "q1")
            root_key = roots.column("key").to_numpy()
            root = [roots.column(c).to_numpy() for c in names]
            lp = np.zeros(len(keys))
            for bit in range(8):
                up_key, above = root_key, root
                for d, own in enumerate(x[bit] for x in levels):
                    at = own.under(up_key)
                    a0, a1, b, q0, q1 = (v[at] for v in above)
                    seen = own.n0 + own.n1
                    e0, e1 = (own.n0 + 0.5) / (seen + 1), (own.n1 + 0.5) / (seen + 1)
                    q0, q1 = np.where(seen > 0, a0 + b * e0, q0), np.where(seen > 0, a1 + b * e1, q1)
                    if own.below is not None:
                        share, rest = _shares(own.kt, own.below)
                        a0, a1, b = a0 + b * share * e0, a1 + b * share * e1, b * rest
                    up_key, above = own.key, [a0, a1, b, q0, q1]
                at = own.of_grams()
                lp += np.log10(np.where(keys >> (7 - bit) & 1, above[4][at], above[3][at]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(m), pa.array(lp)], ["gram", "m", "lp"])

    return scan


def _context(depth: int, top: int) -> Column:
    """The ``top`` nearest bytes of a gram's context."""
    return F.shiftright("key", 8 * (depth + 1 - top))


def dealt_grams(counted: DataFrame, depth: int, group: int) -> tuple[DataFrame, int]:
    """(top, ctx, key, n, c): each gram with its group, of at most ``group`` grams (or
    one context of ``depth - 1`` bytes, at most 65,536); and the greatest ``top``.

    The contexts that are too frequent are at most one for ``group`` grams; they come
    from an aggregate, and each is found by a join.
    """
    first = top = min(TOP, depth - 1)
    dealt = counted.select(F.lit(top).alias("top"), "key", "n", "c")
    while top < depth - 1:
        sizes = dealt.where(F.col("top") == top).groupBy(_context(depth, top).alias("ctx")).agg(F.count("*").alias("grams"))
        frequent = cut(sizes.where(F.col("grams") > group).select("ctx"), "frequent")
        if frequent.isEmpty():
            break
        marked = dealt.withColumn("ctx", _context(depth, top)).join(frequent.withColumn("deeper", F.lit(True)), "ctx", "left")
        # a context of ``top`` bytes is frequent only where all shorter ones are
        dealt = marked.select(F.when(F.col("deeper"), top + 1).otherwise(F.col("top")).alias("top"), "key", "n", "c")
        top += 1
    ctx = F.lit(None).cast("long")
    for t in range(first, top + 1):
        ctx = F.when(F.col("top") == t, _context(depth, t)).otherwise(ctx)
    return dealt.select("top", ctx.alias("ctx"), "key", "n", "c"), top


def tree(counted: DataFrame, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """(gram, m, lp) for counted grams (key, n, c): log10 probability of each byte
    in its context; m counts its places in all texts, c in training."""
    dealt, last = dealt_grams(counted, depth, group)
    roots = dealt.repartition("top", "ctx").sortWithinPartitions("top", "ctx", "key").mapInArrow(_roots(depth), "top int, ctx long, node long, n0 double, n1 double, below double")
    roots = cut(roots, "tree")
    # up: counts, and the log of the children's weighted probability
    kt = log_kt(F.col("n0"), F.col("n1"))
    high = F.greatest("kt", "below")
    weighted = high + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("below")))) - LOG2
    level = roots.where(F.col("top") == last).drop("top").withColumn("root", F.lit(True))
    levels = {last: level}
    for d in range(last - 1, -1, -1):
        up = level.withColumn("kt", kt).withColumn("pw", weighted).groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        up = up.withColumn("root", F.lit(False))
        if d >= min(TOP, depth - 1):
            up = up.unionByName(roots.where(F.col("top") == d).drop("top").withColumn("root", F.lit(True)))
        level = levels[d] = cut(up, "tree")
    # down to the roots
    seen = F.col("n0") + F.col("n1")
    own = [(F.col(n) + 0.5) / (seen + 1.0) for n in ("n0", "n1")]
    share, rest = (1 / (1 + F.exp(F.greatest(F.least(g, F.lit(700.0)), F.lit(-700.0)))) for g in (F.col("below") - kt, kt - F.col("below")))
    state = ["a0", "a1", "b", "q0", "q1"]
    zero = F.lit(0).cast("long")
    above, given = None, []
    for d in range(last + 1):
        level = levels[d]
        if above is None:
            level = level.select("*", F.lit(0.0).alias("a0"), F.lit(0.0).alias("a1"), F.lit(1.0).alias("b"), F.lit(0.5).alias("q0"), F.lit(0.5).alias("q1"))
        else:
            level = level.withColumn("up", F.shiftright("ctx", 8)).join(above.drop("root").withColumnRenamed("ctx", "up"), ["up", "node"])
        ps = [F.when(seen > 0, F.col(f"a{i}") + F.col("b") * own[i]).otherwise(F.col(f"q{i}")).alias(f"q{i}") for i in (0, 1)]
        level = level.withColumn("share", share).withColumn("rest", rest)
        above = level.select("root", "ctx", "node", *((F.col(f"a{i}") + F.col("b") * F.col("share") * own[i]).alias(f"a{i}") for i in (0, 1)), (F.col("b") * F.col("rest")).alias("b"), *ps)
        if d >= min(TOP, depth - 1):
            if d < last:
                above = cut(above, "above")  # read by its groups and by the level below
            given.append(above.where("root").select(F.lit(d).alias("top"), "ctx", F.lit(0).alias("kind"), F.shiftleft("ctx", 8).bitwiseOR(F.col("node")).alias("key"), zero.alias("n"), zero.alias("c"), *state))
    both = dealt.select("top", "ctx", F.lit(GRAM).alias("kind"), "key", "n", "c", *(F.lit(0.0).alias(c) for c in state))
    for x in given:
        both = both.unionByName(x)
    return cut(both.repartition("top", "ctx").sortWithinPartitions("top", "ctx", "kind", "key").mapInArrow(_down(depth), "gram long, m long, lp double"), "grams")


# ------------------------------------------------------------------ lookup
def at_least(df: DataFrame, count: str, most: int) -> int:
    """The least size class of ``count`` (see ``size_class``) that at most ``most`` rows reach."""
    least, held = 1 << 20, 0
    for r in sorted(df.groupBy(size_class(count).alias("size")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.size):
        held += r.n
        if held > most:
            break
        least = r.size
    return least


def size_class(count: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(count), F.lit(1)).cast("double")) * 16)


class Lookup:
    """Values by 64-bit keys: levels of open slots, of which a key takes the
    first that no other key took."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = keys, values
        self.levels: list[tuple[int, np.ndarray]] | None = None

    @staticmethod
    def collect(df: DataFrame, key: str, count: str, values: list[str], most: int) -> Lookup:
        """The rows of greatest ``count``, at most ``most``, 8 bytes for each column."""
        got = df.where(size_class(count) >= at_least(df, count, most)).select(key, *values).toArrow()
        return Lookup(*(got.column(c).to_numpy() for c in (key, *values)))

    @staticmethod
    def _slots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys.view(U64) ^ (keys.view(U64) >> U64(29))) * U64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64)) >> U64(64 - bits)).astype(np.int64)

    def _build(self) -> None:
        self.levels, left = [], np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            bits = max(4, int(2 * len(left)).bit_length())
            at = self._slots(self.keys[left], len(self.levels), bits)
            slot = np.full(1 << bits, -1, np.int32)
            slot[at] = left
            self.levels.append((bits, slot))
            left = left[slot[at] != left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for those not held."""
        if self.levels is None:
            self._build()
        out, todo = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, (bits, slot) in enumerate(self.levels):
            own = keys[todo]
            got = slot[self._slots(own, level, bits)]
            hit = (self.keys[got] == own) & (got >= 0)
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
            if not len(todo):
                break
        return out


# --------------------------------------------------------------- documents
def _tallied(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each of ``n`` rows and how often they occur, with the rows' offsets."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))), np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)


def _sums(shared_words, shared_grams, depth: int):
    """Per document the sums over common words and grams; the others as arrays."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words: Lookup = shared_words.value
        known_grams: Lookup = shared_grams.value
        part, uid = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for a, b in chunks(offs):
                n = b - a
                row, _, _, h = words(data, offs[a : b + 1])
                h = h.view(np.int64)
                at = known_words.find(h)
                hit = at >= 0
                word_sums = [np.bincount(row[hit], weights=v[at[hit]], minlength=n).astype(float) for v in known_words.values]
                rare = [(WORD, *_tallied(row[~hit], h[~hit], n))]
                flat, ends = sequences(data, offs[a : b + 1])
                gram = grams_of(flat, ends, depth)
                at = known_grams.find(gram)
                lost = np.flatnonzero(at < 0)
                lp = known_grams.values[0][at] if len(known_grams.keys) else np.zeros(len(gram))
                lp[lost] = 0
                rare.append((GRAM, *_tallied(np.searchsorted(ends, lost, "right") - 1, gram[lost], n)))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int64))) for _, key, tf, cuts in rare for v in (key, tf)]
                cols = [pa.array(part + uid + np.arange(n)), *(batch.column(c).slice(a, n) for c in ("doc_id", "train")), pa.array(np.bincount(row, minlength=n).astype(np.int64) + 1), pa.array(word_sums[0]), pa.array(word_sums[1].astype(np.int64)), pa.array(np.add.reduceat(lp, ends[:-1])), *lists]
                uid += n
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "train", "n_tokens", "logc", "known", "lp", "w", "w_tf", "g", "g_tf"])

    return scan


def score_documents(docs: DataFrame, train: Column, depth: int = DEPTH, common: int = COMMON, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) per row;
    ``train`` says which rows are learned from."""
    spark = docs.sparkSession
    with scratch(spark) as own_scope:
        own = docs.withColumn("train", F.coalesce(train, F.lit(False))).select("doc_id", "text", "train")
        counted = own.select("text", "train").mapInArrow(_counts(depth), "kind long, key long, n long, c long")
        # tasks have summed their rows, so these go to the shuffle as they are
        counted = cut(counted.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "counts")
        vocabulary = counted.where(F.col("kind") == WORD).select("key", "n", F.log10(F.col("c") + 1.0).alias("logc"), (F.col("c") > 0).cast("double").alias("known"), "c")
        totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.max(F.when(F.col("key") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
        grams = tree(counted.where(F.col("kind") == GRAM), depth)
        frequent = spark.sparkContext.broadcast(Lookup.collect(vocabulary, "key", "n", ["logc", "known"], common))
        nodes = spark.sparkContext.broadcast(Lookup.collect(grams, "gram", "m", ["lp"], common_grams))
        schema = "uid long, doc_id long, train boolean, n_tokens long, logc double, known long, lp double, w array<long>, w_tf array<long>, g array<long>, g_tf array<long>"
        rows = cut(own.mapInArrow(_sums(frequent, nodes, depth), schema), "documents")
        # the others: one join for words and grams
        values = vocabulary.select(F.lit(WORD).alias("kind"), "key", "logc", "known", F.lit(0.0).alias("lp")).unionByName(grams.select(F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), F.lit(0.0).alias("logc"), F.lit(0.0).alias("known"), "lp"))
        rare = [rows.select("uid", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(c, f"{c}_tf")).alias("r")).select("uid", "kind", F.col(f"r.{c}").alias("key"), F.col(f"r.{c}_tf").alias("tf")) for kind, c in ((WORD, "w"), (GRAM, "g"))]
        rare = rare[0].unionByName(rare[1]).join(values, ["kind", "key"])
        rare = rare.groupBy("uid").agg(*(F.sum(F.col("tf") * F.col(c)).alias(f"{c}2") for c in ("logc", "known", "lp")))
        out = rows.drop("w", "w_tf", "g", "g_tf").join(rare, "uid", "left")
        z = lambda c: F.coalesce(c, F.lit(0))
        base = F.col("logc") + z("logc2") + F.lit(math.log10(totals.ends + 1.0)) - F.col("n_tokens") * F.lit(math.log10(totals.n + totals.v + 1))
        known = F.col("known") + z("known2").cast("long") + F.lit(int(totals.ends > 0))
        return own_scope.keep(out.select("doc_id", "train", "n_tokens", known.alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lp") + z("lp2")).alias("score")), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
