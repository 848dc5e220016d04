"""Embedding near-dedup: an exact metric range join through pivots.

Vectors are scaled to length 1; then cosine >= c means distance <= r with
r^2 = 2 - 2c. Equal vectors (of one label) collapse to one with a multiplicity.
Pivots are drawn from the distinct vectors by hash, one for about ``PIVOT_ROWS``; a
vector's home is the cell (label, nearest pivot). A vector v also visits the cell
of a pivot q if v lies within r of the plane that halves the way between q and
its home pivot p: ``d(v, q)^2 - d(v, p)^2 <= 2 r d(p, q)``. A partner w at home in q
lies beyond that plane, so by the triangle inequality (v, w and v's foot on the
plane) none is missed. Cells join on their own: each counts, for homes and
visitors, the links to its homes, and sends out sums and a spanning forest.
Cells larger than ``BLOCK`` are dealt in blocks of homes, and each block meets all
the cell's vectors, block by block of queries.

How many cells a vector visits depends on the vectors: in ``n`` dimensions without
clusters all pivots are nearly as far, and visits grow by a power of the pivots
(17 of 30, 77 of 300 on the sample tables). So a pivot stands for a whole block
of ``BLOCK`` vectors (fewer pivots would replicate blocks, more would replicate
visitors), and an exact join of such vectors stays near all pairs of a label: that
is the price of exactness here. Pivots take ``PIVOT_BYTES`` at most, whatever the
rows, labels and dimensions.

Links are decided by the cosine in double precision.

Defined cases: null vectors, vectors of length 0, with null or non-finite
components, and vectors with a null label or vec_id are linked with nothing (a
null vec_id gets a null component); vectors of different sizes never link, and
any size is allowed; repeated rows are copies that link with each other; a pair
at exactly the threshold is linked; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm.common import bounds, components, cut, local_components, runs, scratch, table

COSINE = 0.98
BLOCK = 8192
PIVOT_ROWS = BLOCK
PIVOT_BYTES = 8 << 20
#: cosines are compared with this slack where only candidates are chosen
SLACK = 1e-6


def unit(values: pa.Array) -> np.ndarray:
    """A matrix of unit vectors from a list column of equal sizes."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def visits(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's home pivot, and the pairs (vector, pivot) of the cells it is in."""
    d2 = 2 - 2 * x @ p.T
    home = d2.argmin(axis=1)
    kinds, at = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(0, 2 - 2 * p[kinds] @ p.T))[at]
    row, cell = np.nonzero(d2 - d2[np.arange(len(x)), home][:, None] <= 2 * radius * apart + SLACK)
    return home, row, cell


def _assign(shared, radius: float):
    """Rows for the home cell and for each cell to visit."""
    names = ["label", "size", "id", "copies", "v"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[tuple[int, int], np.ndarray] = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                label, size = batch.column("label").to_numpy(), batch.column("size").to_numpy()
                for key in sorted(set(zip(label.tolist(), size.tolist()))):
                    own = batch.filter(pa.array((label == key[0]) & (size == key[1])))
                    if key in pivots:
                        home, row, cell = visits(unit(own.column("v")), pivots[key], radius)
                        own, home = own.take(pa.array(row)), cell == home[row]
                    else:
                        cell, home = np.zeros(own.num_rows), np.ones(own.num_rows)
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(cell.astype(np.int64)), pa.array(home.astype(np.int64))], [*names, "cell", "home"])

    return scan


def _join(cosine: float):
    keys = ["label", "size", "cell", "block", "side"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            cut_at = bounds(t, keys)
            for a, b in zip(cut_at, cut_at[1:]):
                own = t.slice(a, b - a).combine_chunks()
                ids, copies = own.column("id").to_numpy(), own.column("copies").to_numpy()
                target = np.flatnonzero(own.column("target").to_numpy())
                query = np.flatnonzero(own.column("query").to_numpy())
                if not len(target) or not len(query):
                    continue
                x = unit(own.column("v").combine_chunks())
                links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for k in range(0, len(query), 512):
                    q = query[k : k + 512]
                    i, j = np.nonzero(x[q] @ x[target].T >= cosine)
                    i, j = q[i], target[j]
                    i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
                    np.add.at(links, i, copies[j])
                    # only the components so far are kept, not the pairs
                    root = local_components(len(ids), root[i], root[j])[root]
                hit = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], ["id", "links", "root"])

    return scan


def draw_pivots(classes: DataFrame, pivot_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """About one distinct vector in ``pivot_rows``, by label and size.

    The keys are hashes, so the choice is as good as random. Where that would be
    more than ``PIVOT_BYTES``, a pivot stands for more of them.
    """
    whole = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("numbers")).first()
    share = max(pivot_rows, -(-8 * whole.numbers // PIVOT_BYTES))
    drawn = classes.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("label", "size", "key", "v").toArrow().sort_by("key")
    label, size = drawn.column("label").to_numpy(), drawn.column("size").to_numpy()
    kinds = set(zip(label.tolist(), size.tolist()))
    return {key: unit(drawn.filter(pa.array((label == key[0]) & (size == key[1]))).column("v").combine_chunks()) for key in sorted(kinds)}


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    with scratch(spark) as own_scope:
        v = F.transform("embedding", lambda x: x.cast("double"))
        rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("size", F.size("v").cast("long"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        fine = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
        rows = cut(rows.withColumn("key", F.when(fine, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))), "vectors")
        same = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("label", "size", "v")))
        classes = cut(same, "vectors")
        radius = float(np.sqrt(2 - 2 * cosine))
        pivots = spark.sparkContext.broadcast(draw_pivots(classes, pivot_rows))
        places = classes.select("label", "size", "id", "copies", "v").mapInArrow(_assign(pivots, radius), "label long, size long, id long, copies long, v array<double>, cell long, home long")
        places = cut(places, "cells")
        cells = places.groupBy("label", "size", "cell").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK)).drop("members")
        # a block of queries meets a block of homes: rows of block i go to (i, *) as queries, homes also to (*, i) as targets
        dealt = places.join(cells, ["label", "size", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        spots = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.when((o == F.col("own")) & (F.col("home") == 1), F.array(F.struct(F.col("own").alias("block"), o.alias("side"), F.lit(1).alias("query"), F.lit(1).alias("target"))))
            .otherwise(F.filter(F.array(F.struct(F.col("own").alias("block"), o.alias("side"), F.lit(1).alias("query"), F.lit(0).alias("target")), F.struct(o.alias("block"), F.col("own").alias("side"), F.lit(0).alias("query"), F.lit(1).alias("target"))), lambda s: (s.query == 1) | ((F.col("home") == 1) & (o != F.col("own")))))))
        dealt = dealt.withColumn("s", F.explode(spots)).select("label", "size", "cell", "s.block", "s.side", "s.query", "s.target", "id", "copies", "v")
        keys = ["label", "size", "cell", "block", "side"]
        found = cut(dealt.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_join(cosine), "id long, links long, root long"), "links")
        linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        sums = found.groupBy("id").agg(F.sum("links").alias("links"))
        about = classes.select("key", "id", "copies").join(sums, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
        about = cut(about.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "components")
        out = rows.select("vec_id", "key").join(about, "key", "left")
        component = F.coalesce("component_id", "vec_id")
        return own_scope.keep(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")), "linked")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x),
c AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
  SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(least(c.low, v.vec_id), v.vec_id) AS component_id,
       coalesce(least(c.low, v.vec_id), v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.x LEFT JOIN c ON v.vec_id = c.x
"""
