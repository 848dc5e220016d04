"""Graph tables that follow a stream of changes.

An extra without a counterpart in batch: a stream of change rows (seq, path, sha,
kind) keeps a table of a repository's current files up to date, one batch at a
time; and windows with a watermark count changes by kind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "seq long, path string, sha string, kind string"


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, sha, seq): the last change of each path wins; deleted ones leave."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("sha", "kind", "seq"), "seq").alias("c")).select("path", "c.*")
    rest = current.join(last.select("path"), "path", "left_anti")
    return rest.unionByName(last.where("kind <> 'deleted'").select("path", "sha", "seq"))


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Maintains versions of the file table under ``table``. A batch that is
    replayed writes its own version again, so each counts once."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        base = files(spark, table, number - 1)
        apply_changes(base, batch).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table after a batch, the last one by default; empty before the first."""
    try:
        if version is None:
            version = spark.read.parquet(table).agg(F.max("v")).first()[0]
        if version is not None and version >= 0:
            return spark.read.schema("path string, sha string, seq long").parquet(f"{table}/v={version}")
    except AnalysisException:
        pass
    return spark.createDataFrame([], "path string, sha string, seq long")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by tumbling windows; works on streams and on tables."""
    t = F.col(time).cast("timestamp")
    out = events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", size).alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col(kind).alias("kind"), "n")


def latest(order: Column, *keys: str) -> Column:
    """Whether a row is the last of its keys; for batch tables of changes."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(order.desc())) == 1
