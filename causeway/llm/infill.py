"""Fill-in-middle transformation, in DuckDB inside ``mapInArrow``.

A task registers each batch of texts as a DuckDB relation and one SELECT does the
work: ``sha256`` of the seed and the doc_id gives four draws, ``regexp_extract_all``
cuts the text into pieces of ``PIECE`` code points (and the two pieces where a cut
falls into single ones), ``list_slice`` takes prefix, middle and suffix, and
``array_to_string`` joins them around the sentinels. The result returns as Arrow;
no Python code sees a row. A lost task is run again with the same result, since the
draws come from the id.

Batches are handed over ``BATCH_BYTES`` of text at a time (one longer text by itself),
so a task holds a few times that, whatever the size of an Arrow batch. DuckDB runs
with one thread, writes no files and reads none.

Defined cases: null text is the empty text, and empty texts stay plain; so do texts
that hold a sentinel, since they could not be told apart again; a null doc_id draws
as the empty string does; rows with equal doc_ids have equal draws, each applied to
its own text; an empty table gives an empty result; all columns are kept, whatever
their names, by ``infilled`` as the struct ``row`` and by ``fill_in_middle`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from causeway.llm.common import chunks, table, text_bytes, wrapped

SEED = "1"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20
PIECE = 64
BATCH_BYTES = 4 << 20

_MACROS = (
    "CREATE MACRO units(x) AS regexp_extract_all(x, '(?s).')",
    f"""CREATE MACRO part(pieces, a, b) AS CASE
    WHEN a >= b THEN ''
    WHEN a // {PIECE} = b // {PIECE} THEN array_to_string(list_slice(units(pieces[a // {PIECE} + 1]), a % {PIECE} + 1, b % {PIECE}), '')
    ELSE array_to_string(list_slice(units(pieces[a // {PIECE} + 1]), a % {PIECE} + 1, {PIECE}), '')
      || array_to_string(list_slice(pieces, a // {PIECE} + 2, b // {PIECE}), '')
      || array_to_string(list_slice(units(coalesce(pieces[b // {PIECE} + 1], '')), 1, b % {PIECE}), '') END""",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def infill_sql(seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """From ``batch`` (i, doc_id, text): i, n, form, prefix_chars, middle_chars, output."""
    p, s, m = map(_quoted, sentinels)
    draw = ", ".join(f"('0x' || substr(x, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
    return f"""
    SELECT i, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN {p} || part(pieces, 0, a) || {s} || part(pieces, b, n) || {m} || part(pieces, a, b)
        ELSE {s} || part(pieces, b, n) || {p} || part(pieces, 0, a) || {m} || part(pieces, a, b) END AS output
    FROM (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
        CASE WHEN form <> 'plain' THEN regexp_extract_all(text, '(?s).{{1,{PIECE}}}') END AS pieces
      FROM (
        SELECT *, CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {int(plain_from)} THEN 'plain'
            WHEN h4 % 100 < {int(spm_below)} THEN 'spm' ELSE 'psm' END AS form
        FROM (SELECT i, text, length(text) AS n, {draw}
          FROM (SELECT i, coalesce(text, '') AS text, sha256({_quoted(seed + ":")} || coalesce(doc_id::VARCHAR, '')) AS x FROM batch))))"""


def restore_sql(of: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The columns of the relation ``of``, and ``restored`` from its output and form.

    A sentinel can't begin inside another, nor in what a text leaves before one, so the
    first that is found is the one that was set.
    """
    p, s, m = map(_quoted, sentinels)
    return f"""
    SELECT * EXCLUDE (ends), CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN ends[1] || split_part(ends[2], {m}, 2) || split_part(ends[2], {m}, 1)
        ELSE split_part(ends[2], {m}, 1) || split_part(ends[2], {m}, 2) || ends[1] END AS restored
    FROM (SELECT *, CASE form WHEN 'psm' THEN string_split(substr(output, length({p}) + 1), {s})
        WHEN 'spm' THEN string_split(substr(output, length({s}) + 1), {p}) END AS ends FROM ({of}))"""


def _in_duckdb(sql: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``sql`` over each batch; ``names`` are the columns that are taken from its
    result, beside the batch's own column ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "autoload_known_extensions": False, "autoinstall_known_extensions": False})
        try:
            for setup in ("SET enable_external_access = false", *_MACROS):
                con.execute(setup)
            for batch in batches:
                _, offsets = text_bytes(batch.column("text"))
                for a, b in chunks(offsets, BATCH_BYTES):
                    own = batch.slice(a, b - a)
                    of = pa.table([pa.array(range(b - a), pa.int64()), own.column("doc_id"), own.column("text").cast(pa.string())], ["i", "doc_id", "text"])
                    con.register("batch", of)
                    out = con.sql(f"SELECT {', '.join(names)} FROM ({sql}) ORDER BY i").to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    cols = [out.column(c).combine_chunks() if out.num_rows else out.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([own.column("row"), *cols], ["row", *names])
        finally:
            con.close()

    return run


_LONGS = {"n", "prefix_chars", "middle_chars"}


def _run(rows: DataFrame, sql: str, names: list[str]) -> DataFrame:
    """``rows``: row, doc_id, text."""
    new = [T.StructField(c, T.LongType() if c in _LONGS else T.StringType()) for c in names]
    return rows.mapInArrow(_in_duckdb(sql, names), T.StructType([rows.schema["row"], *new]))


def _rows(docs: DataFrame) -> DataFrame:
    return wrapped(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def infilled(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output): each row of ``docs`` as a
    struct, and its text in the new order."""
    return _run(_rows(docs), infill_sql(seed, plain_from, spm_below, sentinels), ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the transformed texts, the same columns."""
    out = infilled(docs, **how)
    return out.select(*[(F.col("output") if c == "text" else F.length("output").cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def restored(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(row, output): ``outputs`` (with columns output and form) as structs, and
    the texts as they were before."""
    rows = wrapped(outputs).select("row", F.col("row.form").alias("doc_id"), F.col("row.output").alias("text"))
    sql = f"SELECT i, restored AS output FROM ({restore_sql('SELECT i, doc_id AS form, text AS output FROM batch', sentinels)})"
    return _run(rows, sql, ["output"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them, in one pass."""
    sql = f"SELECT *, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({restore_sql(infill_sql())})"
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select(F.struct("doc_id").alias("row"), "doc_id", "text")
    return _run(rows, sql, names).select("row.doc_id", *names)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS c1, ('0x' || x[9:16])::BIGINT % (n + 1) AS c2, ('0x' || x[17:24])::BIGINT % 100 AS c3, ('0x' || x[25:32])::BIGINT % 100 AS c4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN n = 0 OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, left(text, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
