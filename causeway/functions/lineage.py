"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master, whose tasks share the
    driver's disk, may leave it unset; it then gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: The folders of the innermost scope; threads and async tasks each have their own.
_inner: ContextVar[list[str] | None] = ContextVar("_inner", default=None)


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed with what its scope cuts."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    own = _inner.get()
    if own is not None:
        own.append(path)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back.

    Loops keep short plans, and a lost executor costs one read.
    """
    return _written(df, what, _inner.get())


def _written(df: DataFrame, what: str, into: list[str] | None) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if into is not None:
        into.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """What is cut inside the scope; ``keep`` writes a result that outlives it."""

    def __init__(self, outer: list[str] | None):
        self.outer = outer

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        return _written(df, what, self.outer)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of what is cut inside the scope."""
    paths: list[str] = []
    token = _inner.set(paths)
    try:
        yield paths
    finally:
        _inner.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind what has been written: it does so
    when their plans are collected as garbage, else not before memory is short."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Removes, at its end, the folders of all that was cut inside."""
    outer = _inner.get()
    with recorded() as paths:
        try:
            yield Scratch(outer)
        finally:
            remove(spark, paths)
