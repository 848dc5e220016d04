"""MinHash near-duplicate detection by a multi-index Hamming join.

A document is the set of its distinct word shingles. Two documents are linked
when ``100 * |A & B| >= percent * |A | B|``; the result has each document's class
and component.

1. Equal sets collapse to one class (a 128-bit sum over the set), so copies cost
   nothing later.
2. Each class gets a signature of ``slots`` minima of b = 16 bits. Two sets of
   similarity s differ in a slot with probability 1 - s.
3. The signature is split into ``chunks``. By the pigeonhole principle, two
   signatures that differ in at most ``2 * chunks - 1`` slots (the distance
   threshold) have a chunk with at most one error, which is enumerated: a chunk
   yields, for each of its slots, a key of the others. So every pair within
   the threshold shares a key. A pair at the similarity threshold exceeds it
   with a probability near 1e-5 (50 slots, 10 chunks, 0.85) or 1e-6 (48, 12, 0.8).
4. Under each key, members are held against the key's smallest member, natively,
   by the signatures' distance. Those near it are joined to it; the others (far
   ones) meet all members in a grid, a block of far ones and a block of members
   to a task, and are joined to all they are near to. This gives families:
   everything that links lies in one family, and no pair inside a family needs to
   be listed.
5. A family's full sets are gathered once, and intersections are counted exactly
   through an inverted index in the task. Large families go in blocks, first
   against the family's smallest member alone; only what isn't linked to it meets
   the others, in a grid as above. Only a spanning forest of the confirmed links
   comes out.

Rows are told apart by a number of their own, not by their doc_id.

Defined cases: null or empty text and text of white space have an empty set and
are linked with nothing; fewer words than a shingle are one shingle; texts of any
length are read whole; rows with equal sets are copies of each other; rows of one
doc_id with different texts are documents of their own, each in its own text's
component; a component's id is its smallest doc_id, null where it has none, and
rows with a null doc_id are never ``kept``; an empty table gives an empty result;
extra columns are ignored. ``one_of_each`` keeps exactly one row of each component
(smallest doc_id, nulls last), whatever the doc_ids, and all rows without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causeway.llm.common import U64, bounds, components, cut, local_components, mix, runs, scratch, shingle_sets, table, text_bytes, wrapped

KEY_ROWS = 1024
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, the least similarity in percent, and the index."""

    words: int = 5
    percent: int = 80
    slots: int = 48
    chunks: int = 12

    @property
    def most(self) -> int:
        """The largest signature distance that the index guarantees to find."""
        return 2 * self.chunks - 1

    @property
    def longs(self) -> int:
        return -(-self.slots // 8)

    def spans(self) -> list[tuple[int, int]]:
        at = np.linspace(0, self.slots, self.chunks + 1).round().astype(int)
        return list(zip(at, at[1:]))


STRICT = Scheme(words=3, percent=85, slots=50, chunks=10)


def _signatures(s: Scheme):
    seeds = mix(np.arange(1, 2 * s.slots + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
    xors, odd = seeds[: s.slots], seeds[s.slots :] | U64(1)

    def minima(u: np.ndarray) -> np.ndarray:
        low = np.full(s.slots, np.iinfo(U64).max, U64)
        for a in range(0, len(u), 2048):
            low = np.minimum(low, ((u[a : a + 2048, None] ^ xors) * odd).min(axis=0))
        return low

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            n, sums, low = [], [], []
            for u in shingle_sets(data, offs, s.words):
                n.append(len(u))
                sums.append((int(u.sum()), int(mix(u ^ U64(0x5DEECE66D)).sum())))
                low.append(minima(u) if len(u) else np.zeros(s.slots, U64))
            sig = (mix(np.array(low, U64).reshape(-1, s.slots)) >> U64(48)).astype(U64)
            keys = np.empty((len(n), s.slots), U64)
            for a, b in s.spans():
                for j in range(a, b):
                    k = np.full(len(n), j + 1, U64)
                    for i in range(a, b):
                        if i != j:
                            k = mix(k) + sig[:, i]
                    keys[:, j] = mix(k)
            bytes_ = np.zeros((len(n), 8 * s.longs), np.uint8)
            bytes_[:, : s.slots] = (sig & U64(0xFF)).astype(np.uint8)
            packed = bytes_.view("<i8")
            both = np.array(sums, U64).reshape(-1, 2).view(np.int64)
            cols = [batch.column("tag"), batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            cols += [pa.array(packed[:, i].copy()) for i in range(s.longs)]
            cols.append(pa.ListArray.from_arrays(np.arange(0, (len(n) + 1) * s.slots, s.slots, dtype=np.int32), pa.array(keys.view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays(cols, ["tag", "doc_id", "text", "n", "e1", "e2", *(f"s{i}" for i in range(s.longs)), "keys"])

    sig_cols = ", ".join(f"s{i} long" for i in range(s.longs))
    return scan, f"tag long, doc_id long, text string, n long, e1 long, e2 long, {sig_cols}, keys array<long>"


def _distance(s: Scheme, a: str, b: str) -> Column:
    """Slots whose low bytes differ, by 64-bit words."""
    def differing(i: int) -> Column:
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        for n in (4, 2, 1):  # the lowest bit of each byte becomes the "or" of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda x, y: x + y, [differing(i) for i in range(s.longs)])


def _forests(links, keys: list[str]):
    """Runs ``links`` on each cell; only a spanning forest leaves the task.

    ``links`` gets a cell's rows and returns linked positions, of a row with
    ``near`` on the left and one with ``near`` on the right.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            cut_at = bounds(t, keys)
            a_, b_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(cut_at, cut_at[1:]):
                if b - a < 2:
                    continue
                cell = t.slice(a, b - a).combine_chunks()
                names, at = np.unique(cell.column("id").to_numpy(), return_inverse=True)
                i, j = (at[x] for x in links(cell))
                root = local_components(len(names), i, j)
                moved = np.flatnonzero(root != np.arange(len(names)))
                a_.append(names[moved])
                b_.append(names[root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_)), pa.array(np.concatenate(b_))], ["a", "b"])

    return scan


LEFT, RIGHT, BOTH = 1, 2, 3


def grid(far: DataFrame, members: DataFrame, key: str, far_blocks: str, blocks: str) -> DataFrame:
    """Cells (key, x, y) in which block x of ``far`` meets block y of ``members``."""

    def spread(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("long").alias("x" if side == LEFT else "y")
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1)).alias("y" if side == LEFT else "x")
        return df.select(key, mine, others, "id", F.lit(side).cast("long").alias("side"))

    return spread(far, far_blocks, blocks, LEFT).unionByName(spread(members, blocks, far_blocks, RIGHT))


def _near(s: Scheme):
    """The pairs of a cell that are within the signature distance."""
    cols = [f"s{i}" for i in range(s.longs)]

    def links(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = cell.column("side").to_numpy()
        sig = np.column_stack([cell.column(c).to_numpy() for c in cols]).view(np.uint8)
        right = np.flatnonzero(side == RIGHT)
        a_, b_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(side == LEFT):
            hit = right[(sig[right] != sig[i]).sum(axis=1) <= s.most]
            a_.append(np.full(len(hit), i))
            b_.append(hit)
        return np.concatenate(a_), np.concatenate(b_)

    return links


def families(classes: DataFrame, s: Scheme) -> DataFrame:
    """(node, component): classes that may be linked, directly or in turn."""
    sig = [f"s{i}" for i in range(s.longs)]
    rows = classes.select("id", F.explode("keys").alias("key"))
    first = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1")
    shared = cut(rows.join(cut(first, "keys"), "key"), "members")
    # the same pair meets under many keys; its distance is taken once
    pairs = shared.where("id <> first").select("id", "first").distinct()
    own = classes.select("id", *sig)
    lead = classes.select(F.col("id").alias("first"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(sig)))
    pairs = cut(pairs.join(own, "id").join(lead, "first").select("id", "first", (_distance(s, "s", "f") > s.most).alias("far")), "pairs")
    stars = pairs.where("not far").select(F.col("id").alias("a"), F.col("first").alias("b"))
    far = cut(shared.join(pairs.where("far"), ["id", "first"]).select("key", "id", "members"), "far")
    blocks = far.groupBy("key").agg(F.ceil(F.count("*") / KEY_ROWS).alias("far_blocks"), F.ceil(F.max("members") / KEY_ROWS).alias("blocks"))
    blocks = cut(blocks, "far")
    cells = grid(far.select("key", "id").join(blocks, "key"), shared.select("key", "id").join(blocks, "key"), "key", "far_blocks", "blocks").join(own, "id")
    keys = ["key", "x", "y"]
    found = cells.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_forests(_near(s), keys), "a long, b long")
    return components(stars.unionByName(found))


def _gather(s: Scheme):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            sets = [u.tobytes() for u in shingle_sets(data, offs, s.words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return scan


def confirmed(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of positions, left and right, by exact intersections."""
    n = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(code, kind="stable")
    posting = owner[by]
    head = np.searchsorted(code[by], np.arange(code.max() + 2))
    right = side & RIGHT > 0
    a_, b_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(side & LEFT):
        own = code[at[i] : at[i + 1]]
        size = head[own + 1] - head[own]
        first = np.repeat(head[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        common = np.bincount(posting[first + np.arange(len(first))], minlength=len(sets))
        hit = np.flatnonzero((100 * common >= percent * (n + n[i] - common)) & right)
        a_.append(np.full(len(hit), i))
        b_.append(hit)
    return np.concatenate(a_), np.concatenate(b_)


def _confirmed(s: Scheme):
    def links(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, "<u8") for x in cell.column("set").to_pylist()]
        return confirmed(sets, cell.column("side").to_numpy(), s.percent)

    return links


def confirm(sets: DataFrame, families: DataFrame, s: Scheme) -> DataFrame:
    """Forests (a, b) of the confirmed links of ``families`` (family, id, blocks)
    with the members' ``sets`` (id, set)."""
    keys = ["family", "x", "y"]

    def forests(cells: DataFrame) -> DataFrame:
        rows = cells.join(sets, "id").select(*keys, "id", "side", "set")
        return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_forests(_confirmed(s), keys), "a long, b long")

    zero = F.lit(0).cast("long")
    small = forests(families.where("blocks = 1").select("family", zero.alias("x"), zero.alias("y"), "id", F.lit(BOTH).cast("long").alias("side")))
    large = cut(families.where("blocks > 1"), "large")
    if not large.head(1):
        return small
    # a family bears the name of its smallest member, so that is each cell's root
    first = large.where("id = family").withColumn("one", F.lit(1))
    stars = cut(forests(grid(first, large.where("id <> family").withColumn("one", F.lit(1)), "family", "one", "blocks")), "stars")
    rest = large.where("id <> family").join(stars.select(F.col("a").alias("id")), "id", "left_anti")
    share = rest.groupBy("family").agg((F.ceil(F.count("*") * F.max("blocks") / F.max("docs"))).alias("rest_blocks"))
    share = cut(share, "rest")
    cells = grid(rest.join(share, "family"), large.join(share, "family"), "family", "rest_blocks", "blocks")
    return small.unionByName(stars).unionByName(forests(cells))


def marked(docs: DataFrame, s: Scheme) -> DataFrame:
    """(tag, doc_id, n_shingles, component_id, kept, stays) for rows (tag, doc_id,
    text) with a number ``tag`` of their own; ``stays`` holds for one row of each
    component and for all rows without words."""
    spark = docs.sparkSession
    with scratch(spark) as own_scope:
        scan, schema = _signatures(s)
        rows = cut(docs.select("tag", "doc_id", "text").mapInArrow(scan, schema), "signatures")
        sig = [f"s{i}" for i in range(s.longs)]
        # one row for each set, with the number of one of its rows; copies meet in a partial aggregate before the shuffle
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("best")
        same = rows.where("n > 0").groupBy("n", "e1", "e2").agg(F.min("tag").alias("id"), best, *(F.min(c).alias(c) for c in sig), F.first("keys").alias("keys"))
        classes = cut(same, "classes")
        family = cut(families(classes, s).withColumnsRenamed({"node": "id", "component": "family"}), "families")
        sizes = family.join(classes.select("id", "n"), "id").groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
        sizes = sizes.select("family", "docs", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks"))
        member = cut(family.join(sizes, "family"), "families")
        texts = rows.select(F.col("tag").alias("id"), "text").join(member.select("id"), "id", "left_semi")
        sets = cut(texts.mapInArrow(_gather(s), "id long, set binary"), "sets")
        linked = components(confirm(sets, member, s)).withColumnRenamed("node", "id")
        about = classes.select("id", "n", "e1", "e2", "best").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        about = cut(about, "components")
        top = about.groupBy("component").agg(F.min("best").alias("best"))
        about = cut(about.select("n", "e1", "e2", "component").join(top, "component").select("n", "e1", "e2", "best"), "components")
        out = rows.select("tag", "doc_id", "n", "e1", "e2").join(about, ["n", "e1", "e2"], "left")
        component = F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
        stays = F.coalesce(F.col("best.tag") == F.col("tag"), F.lit(True))
        return own_scope.keep(out.select("tag", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), stays.alias("stays")), "marks")


def near_duplicates(docs: DataFrame, s: Scheme = Scheme()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    return marked(docs.withColumn("tag", F.monotonically_increasing_id()), s).drop("tag", "stays")


def one_of_each(docs: DataFrame, s: Scheme = Scheme()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates."""
    rows = cut(wrapped(docs).withColumn("tag", F.monotonically_increasing_id()), "tagged")
    stays = marked(rows.select("tag", "row.doc_id", "row.text"), s).where("stays").select("tag")
    return rows.join(stays, "tag", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), STRICT)
