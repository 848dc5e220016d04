"""A training corpus from raw documents: five stages, each with one operator.

Quality classification drops documents, line dedup rewrites texts, near-duplicate
detection keeps one document of each group, mixing leaves out or repeats documents
by their source's target, and packing returns the pieces of token sequences.

A stage's rows are written before the next stage begins; ``run`` then removes the
folders that stood behind them, and its own once the next stage has read them. Stages
called by themselves leave the folders that their results read in the shared folder.

Defined cases, for every stage: rows are told apart by themselves, so rows of one
or of no doc_id are documents of their own, except that line dedup takes rows of
one doc_id as one document; null and empty texts are documents (scored by their
statistics, one empty line, never near-duplicates, of size 0 and so left out by
mixing, one separator); texts of any length are read whole; repeated rows are
scored alike, lose no lines to each other, leave one row in near dedup, and are
mixed and packed each by itself; ties go by doc_id, then by a row's running number;
empty tables give empty results; extra columns, whatever their names, are kept by
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.lineage import recorded, remove, scratch
from causeway.llm import linededup, mixing, neardup, packing, quality
from causeway.llm.common import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least ``quality.THRESHOLD``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of smallest doc_id."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document once for each pass of the mix that takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tree ensembles, signatures and token ids are beyond SQL; tests/llm holds the
#: stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    behind: list[str] = []  # the folder that holds ``docs``
    for name, stage in STAGES[:-1]:
        with recorded() as own:
            with scratch(spark) as stage_scope:
                docs = stage_scope.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, behind)
        behind = own
    with scratch(spark) as last:
        out = last.keep(STAGES[-1][1](spark, docs, sf_dir), "pieces")
    remove(spark, behind)
    return out
