"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time ``t`` in [0, 1]: its
share of the mix moves linearly from ``1 - tilt`` to ``1 + tilt`` times its
mean. The integral of the schedule is the source's cumulative token demand;
a document whose tokens begin at ``c`` of a source's ``target`` gets the
position ``t`` where that demand reaches ``c``. Where the target exceeds the
source, its documents come a second time, at the positions of ``source_size + c``.
Documents are then range-sorted by position. The query, whose rows are fixed by
its SQL, names each document's first position; ``passes`` has one row per pass.

Targets are fixed by water-filling: weight times a common level, stopped at
``most`` times the source's own size.

Everything is DataFrame code. The running sums inside a source, which may hold
a third of all rows, are taken in steps: sums of runs of hash buckets, of the
buckets of a run, then inside each bucket, so no task gets a whole source. Only
the targets see all sources at once, one row for each.

Defined cases: texts of any length are counted whole; a null or empty text has size 0 and takes nothing; null sources
are one source, which sorts last; repeated rows are documents of their own
(equal ids and texts differ only by a running number, so the assignment stays
the same in reruns) and rows of equal or null ids are dealt each by itself; ties of
position are in the order of that number; extra columns, of any name, are kept by
``mixed_documents`` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from causeway.llm.common import cut, scratch, table, wrapped

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
TILT = 0.5
BUCKET_ROWS = 400
RUN_BUCKETS = 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Per source (one row each): source_size, weight, target.

    ``sizes`` has (source, source_size). The level is found in closed form:
    with sources in order of capacity per weight, the first k are full, and
    the level of the rest is what remains divided by their weight.
    """
    whole = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    order = whole.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole)
    ranked = ranked.select(
        "*",
        (F.col("source_size") * F.lit(most)).alias("room"),
        (total * F.lit(share) - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(most)).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("open"),
    )
    ranked = ranked.withColumn("level", F.col("left") / F.col("open"))
    level = F.max(F.when(F.col("room") >= F.col("level") * F.col("weight"), F.col("level"))).over(whole)
    return ranked.select(*sizes.columns, "weight", F.least("room", F.coalesce(level * F.col("weight"), F.col("room"))).alias("target"))


def position(c: Column, target: Column, tilt: Column) -> Column:
    """t with D(t) = c, for D(t) = target * ((1 - tilt) t + tilt t^2)."""
    b, y = 1 - tilt, c / target
    return F.when(target <= 0, F.lit(0.0)).when(F.abs(tilt) < 1e-9, y).otherwise((-b + F.sqrt(b * b + 4 * tilt * y)) / (2 * tilt))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, tilt=TILT) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source) with size, source_size,
    target, taken, first_words, second_words, position; sorted by position.

    ``taken`` counts the words of the first and, where the target exceeds the
    source, of the second pass; the document at the edge is taken in part, so a
    source's sum is its target rounded down. Documents that the mix leaves out
    have position null. The text is not carried.
    """
    out = _planned(docs.select("doc_id", "text", "source", F.lit(0).alias("tag")), weights, share, most, tilt)
    out = out.select("doc_id", "source", "size", "source_size", "target", (F.col("first_words") + F.col("second_words")).alias("taken"), "first_words", "second_words", F.col("first_at").alias("position"))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def passes(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, tilt=TILT) -> DataFrame:
    """(tag, source, target, pass, words, position) of documents (doc_id, text,
    source, tag): a row for each pass that takes words of a row; in no order."""
    both = F.array(*[F.struct(F.lit(i).alias("pass"), F.col(f"{k}_words").alias("words"), F.col(f"{k}_at").alias("position")) for i, k in enumerate(("first", "second"), 1)])
    out = _planned(docs, weights, share, most, tilt).select("tag", "source", "target", F.explode(both).alias("p"))
    return out.select("tag", "source", "target", "p.*").where("words > 0")


def _planned(docs: DataFrame, weights, share, most, tilt) -> DataFrame:
    """Each row's words and position of the first and of the second pass."""
    source = F.col("source").cast("string")
    own = docs.select("doc_id", "tag", source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), n_words("text").alias("size"), F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).alias("h"))
    own = cut(own, "sizes")
    per = own.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per.select(F.expr("substr(nullif(key, ''), 2)").alias("source"), "key", "source_size"), weights, share, most)
    most_rows = per.agg(F.max("n")).first()[0] or 0
    n_buckets = max(1, -(-most_rows // BUCKET_ROWS))
    own = own.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * n_buckets / F.lit(1 << 24)))
    sums = own.groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket"))
    # running sums over runs of buckets, then over the buckets of a run
    sums = sums.withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS))
    before = lambda keys, by: W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    long_ = sums.groupBy("key", "run").agg(F.sum("in_bucket").alias("in_run"))
    long_ = long_.select("key", "run", F.coalesce(F.sum("in_run").over(before(["key"], "run")), F.lit(0)).alias("run_base"))
    sums = sums.withColumn("short", F.coalesce(F.sum("in_bucket").over(before(["key", "run"], "bucket")), F.lit(0)))
    sums = sums.join(long_, ["key", "run"]).select("key", "bucket", (F.col("run_base") + F.col("short")).alias("base"))
    goal = cut(sums.join(goal.drop("source"), "key"), "targets")
    inside = W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "tag").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = own.join(goal, ["key", "bucket"]).withColumn("c", F.col("base") + F.col("inner"))
    clamp = lambda left: F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    words = F.floor("target")
    out = out.withColumn("first_words", clamp(words - F.col("c"))).withColumn("second_words", clamp(words - F.col("source_size") - F.col("c")))
    slope = F.lit(tilt) * F.when(F.col("weight") >= F.lit(float(max(weights))), 1.0).otherwise(-1.0)
    at = lambda c: position(F.least(c.cast("double"), F.col("target")), F.col("target"), slope)
    out = out.withColumn("first_at", F.when(F.col("first_words") > 0, at(F.col("c"))))
    out = out.withColumn("second_at", F.when(F.col("second_words") > 0, at(F.col("source_size") + F.col("c"))))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


#: The same by plain windows: order of md5 inside a source, water-filling, clamped running sums.
SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, coalesce(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM s),
q AS (
  SELECT *, source_size * 2.0::DOUBLE AS room,
         sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER w, 0) * 2.0::DOUBLE AS lft,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS opn
  FROM r WINDOW w AS (ORDER BY source_size::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, weight, least(room, coalesce(max(CASE WHEN room >= lft / opn * weight THEN lft / opn END) OVER () * weight, room)) AS target
  FROM q),
c AS (
  SELECT d.doc_id, d.size, t.*,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - c)) AS w1, greatest(0, least(size, floor(target)::BIGINT - source_size - c)) AS w2,
         CASE WHEN weight >= 5 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt
  FROM c)
SELECT doc_id, size, source_size, target, (w1 + w2)::BIGINT AS taken,
       CASE WHEN w1 > 0 THEN round((-(1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (least(c::DOUBLE, target) / target))) / (2 * tilt), 6) + 0.0 END AS position
FROM k
"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document stands once for
    each pass that takes it, and is left out if neither does. Rows are written in
    the order of their training positions.

    Decisions are made by row, whatever its doc_id: rows are written once with
    a number of their own, which is then a fixed part of them.
    """
    rows = cut(wrapped(docs).withColumn("tag", F.monotonically_increasing_id()), "tagged")
    with scratch(docs.sparkSession) as own_scope:
        plan = own_scope.keep(passes(rows.select("row.doc_id", "row.text", "row.source", "tag")).select("tag", "position"), "passes")
    return rows.join(plan, "tag").repartitionByRange("position", "tag").sortWithinPartitions("position", "tag").select("row.*")
