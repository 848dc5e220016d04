"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

A transcript is a sequence of blocks (turns without trustworthy roles). The
hidden state is the block's role. Observations are a speaker marker at the
start of the block, if any ("User:", "### Response", "<|system|>"), and
features of its lines: length, lines, question marks, place in the
conversation. The emission of a state is a product of smoothed categorical
tables; all tables are counted, by Spark, over conversations whose
crc32(conv_id) mod 5 is not 0. Viterbi recovers the roles; markers are
stripped, neighbours of one role merged, and turns rendered as
``<|role|>\\ntext<|end|>``.

A conversation may be of any length: its blocks are cut into runs of
``RUN`` turns. Each run is one max-plus matrix (best score from any state before
it to any state at its end). Matrices multiply in groups of ``FAN``, level by level,
until a conversation is one group; then the states at the borders are fixed from
the top level down, and every run is decoded on its own. So a task holds one run, or
the matrices of one group, whatever the length of a conversation.

Defined cases: null and empty texts are blocks without lines, and texts of any
length are one block; null turns come first, ties are ordered by a hash of the
text, then by role, and repeated rows are blocks of their own; null conv_ids are
one conversation, apart from that of an empty conv_id; with no
known roles nothing can be learned and every block is a ``user``'s; an empty
table gives an empty result; extra columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from causeway.llm.common import bounds, cut, runs, scratch, table

ROLES = ("assistant", "system", "user")
#: words that name a speaker, by the role they speak for
SPEAKERS = {
    "assistant": ("assistant", "ai", "bot", "model", "response", "answer", "gpt"),
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "prompt", "customer", "input"),
}
RUN = 256
FAN = 256
MARKER = r"(?i)^\s*(?:<\|(\w+)\|>|#{1,4}\s*(\w+)\s*:?(?=\n|$)|\[(\w+)\]\s*:?|\**(\w+)\**\s*:)\s*"


def marker(text: Column) -> Column:
    """The role that a block's speaker marker names, '' without one."""
    word = F.lower(F.concat(*[F.coalesce(F.regexp_extract(text, MARKER, i), F.lit("")) for i in (1, 2, 3, 4)]))
    out = F.lit("")
    for role, names in SPEAKERS.items():
        out = F.when(word.isin(*names), role).otherwise(out)
    return out


def stripped(text: Column) -> Column:
    return F.when(marker(text) != "", F.regexp_replace(text, MARKER, "")).otherwise(text)


def conversation() -> Column:
    """A conversation's key; a null conv_id is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def features(blocks: DataFrame) -> DataFrame:
    """``blocks`` (conv_id, turn, text) with seq, run and categorical features.

    Blocks are range-sorted by (conversation, turn, text), so a long conversation,
    or one whose turns are all equal or null, is spread over tasks: a block's place
    is that in its range, and conversations that go on from an earlier range (one
    for each range at most) add what they have there.
    """
    text = F.coalesce("text", F.lit(""))
    blocks = blocks.select("conv_id", "turn", "text", *[c for c in ("role",) if c in blocks.columns])
    blocks = blocks.withColumn("conv", conversation()).withColumn("hash", F.xxhash64("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "hash", F.monotonically_increasing_id()]
    sort = [*order[:3], *[F.col(c).asc_nulls_first() for c in ("role",) if c in blocks.columns]]
    blocks = blocks.repartitionByRange(*order).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    blocks = cut(blocks.withColumn("range", F.shiftright("at", 33)), "ordered")
    count = blocks.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    place = cut(count.select("conv", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranges")
    blocks = blocks.join(place, ["conv", "range"]).withColumn("seq", F.col("base") + F.col("at") - F.col("first"))
    size = F.length(text)
    return blocks.select(
        "conv_id", "conv", "turn", "text", *[c for c in ("role",) if c in blocks.columns], "seq", F.floor(F.col("seq") / RUN).cast("long").alias("run"),
        marker(text).alias("f_marker"),
        F.least(F.floor(F.log2(size + 1.0)), F.lit(14)).cast("string").alias("f_size"),
        F.least(F.regexp_count(text, F.lit("\n")), F.lit(6)).cast("string").alias("f_lines"),
        (F.instr(text, "?") > 0).cast("string").alias("f_question"),
        (F.col("seq") == 0).cast("string").alias("f_first"),
    )


FEATURES = ("f_marker", "f_size", "f_lines", "f_question", "f_first")


class Model:
    """Log tables of the chain, from counts with add-one smoothing."""

    def __init__(self, start: dict, step: dict, emit: dict):
        n = len(ROLES)
        self.start = np.log(np.array([start.get(r, 0) + 1.0 for r in ROLES]))
        self.start -= np.log(np.exp(self.start).sum())
        m = np.array([[step.get((a, b), 0) + 1.0 for b in ROLES] for a in ROLES])
        self.step = np.log(m / m.sum(axis=1, keepdims=True))
        self.emit: dict[str, dict[str, np.ndarray]] = {}
        self.unseen: dict[str, np.ndarray] = {}
        for f in FEATURES:
            values = sorted({v for g, v, _ in emit if g == f})
            c = np.array([[emit.get((f, v, r), 0) + 1.0 for r in ROLES] for v in values]).reshape(-1, n)
            total = c.sum(axis=0) + 1.0
            self.emit[f] = dict(zip(values, np.log(c / total)))
            self.unseen[f] = np.log(1.0 / total)
        # a marker names its role even where training texts have none
        for i, r in enumerate(ROLES):
            self.emit["f_marker"].setdefault(r, np.where(np.arange(n) == i, math.log(0.9), math.log(0.1 / (n - 1))))

    def scores(self, rows: pa.Table) -> np.ndarray:
        out = np.zeros((rows.num_rows, len(ROLES)))
        for f in FEATURES:
            col = rows.column(f).combine_chunks().dictionary_encode()
            if isinstance(col, pa.ChunkedArray):
                col = col.combine_chunks()
            own = np.array([self.emit[f].get(v, self.unseen[f]) for v in col.dictionary.to_pylist()]).reshape(-1, len(ROLES))
            out += own[col.indices.to_numpy()]
        return out


def held_out(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(conv_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(blocks: DataFrame) -> Model:
    """Counts over the blocks of known role; three small aggregates."""
    known = blocks.where(F.col("role").isin(*ROLES))
    start = {r.role: r.n for r in known.where("seq = 0").groupBy("role").agg(F.count("*").alias("n")).collect()}
    follow = known.select("conv", "seq", "role")
    step = follow.join(follow.select("conv", (F.col("seq") + 1).alias("seq"), F.col("role").alias("was")), ["conv", "seq"])
    steps = {(r.was, r.role): r.n for r in step.groupBy("was", "role").agg(F.count("*").alias("n")).collect()}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("p")
    emit = {(r.f, r.v, r.role): r.n for r in known.select("role", pairs).groupBy("p.f", "p.v", "role").agg(F.count("*").alias("n")).collect()}
    return Model(start, steps, emit)


def _run_scores(model: Model, rows: pa.Table, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Emissions, and the max-plus matrix from the state before the run to the
    state at its end (one row, for any state before, at a conversation's start)."""
    e = model.scores(rows)
    m = (np.tile(model.start, (len(ROLES), 1)) if first else model.step) + e[0]
    for x in e[1:]:
        m = (m[:, :, None] + model.step[None]).max(axis=1) + x
    return e, m


def _matrices(model: Model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["conv", "run"]):
            cut_at = bounds(t, ["conv", "run"])
            conv, run, m = [], [], []
            for a, b in zip(cut_at, cut_at[1:]):
                rows = t.slice(a, b - a)
                conv.append(rows.column("conv")[0].as_py())
                run.append(rows.column("run")[0].as_py())
                m.append(_run_scores(model, rows, run[-1] == 0)[1].ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(run, pa.int64()), pa.array(m, pa.list_(pa.float64()))], ["conv", "run", "m"])

    return scan


def _groups(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, matrices) of the groups of a table of ``runs``."""
    n = len(ROLES)
    cut_at = bounds(t, ["conv", "g"])
    for a, b in zip(cut_at, cut_at[1:]):
        yield a, b, np.array(t.column("m").slice(a, b - a).to_pylist()).reshape(-1, n, n)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each group of neighbours."""
    for t in runs(batches, ["conv", "g"]):
        first, whole = [], []
        for a, _, ms in _groups(t):
            first.append(a)
            out = ms[0]
            for m in ms[1:]:
                out = (out[:, :, None] + m[None]).max(axis=1)
            whole.append(out.ravel().tolist())
        own = t.take(pa.array(first, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("conv").combine_chunks(), own.column("g").combine_chunks(), pa.array(whole, pa.list_(pa.float64()))], ["conv", "run", "m"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and at the end of each member of a group, given those of the group; -1 is none yet."""
    for t in runs(batches, ["conv", "g"]):
        starts, ends = t.column("before").to_numpy(), t.column("end").to_numpy()
        before, end = np.empty(t.num_rows, np.int64), np.empty(t.num_rows, np.int64)
        for a, b, ms in _groups(t):
            best, back = ms[0][max(starts[a], 0)], []  # all rows of a conversation's first matrix are equal
            for m in ms[1:]:
                whole = best[:, None] + m
                back.append(whole.argmax(axis=0))
                best = whole.max(axis=0)
            state = int(best.argmax()) if ends[a] < 0 else int(ends[a])
            for k in range(b - 1, a - 1, -1):
                end[k] = state
                state = int(back[k - a - 1][state]) if k > a else int(starts[a])
                before[k] = state
        keep = t.select(["conv", "run"]).combine_chunks()
        yield pa.RecordBatch.from_arrays([keep.column("conv").combine_chunks(), keep.column("run").combine_chunks(), pa.array(before), pa.array(end)], ["conv", "run", "before", "end"])


def _fold(matrices: DataFrame) -> DataFrame:
    """(conv, run, before, end): the best states at the borders of all runs."""
    g = F.floor(F.col("run") / FAN).cast("long")
    levels = [cut(matrices, "matrices")]
    while levels[-1].where(F.col("run") >= FAN).head(1):
        rows = levels[-1].withColumn("g", g).repartition("conv", "g").sortWithinPartitions("conv", "g", "run")
        levels.append(cut(rows.mapInArrow(_multiply, "conv string, run long, m array<double>"), "matrices"))
    known = levels[-1].select("conv", F.lit(0).cast("long").alias("g")).distinct().select("*", F.lit(-1).cast("long").alias("before"), F.lit(-1).cast("long").alias("end"))
    for level in reversed(levels):
        rows = level.withColumn("g", g).join(known, ["conv", "g"]).repartition("conv", "g").sortWithinPartitions("conv", "g", "run")
        ends = rows.mapInArrow(_borders, "conv string, run long, before long, end long")
        known = ends.withColumnRenamed("run", "g")
    return ends


def _decode(model: Model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["conv", "run"]):
            cut_at = bounds(t, ["conv", "run"])
            roles: list[str] = []
            for a, b in zip(cut_at, cut_at[1:]):
                rows = t.slice(a, b - a)
                before, end = rows.column("before")[0].as_py(), rows.column("end")[0].as_py()
                e = model.scores(rows)
                best = (model.start if before < 0 else model.step[before]) + e[0]
                back = []
                for x in e[1:]:
                    whole = best[:, None] + model.step
                    back.append(whole.argmax(axis=0))
                    best = whole.max(axis=0) + x
                path = [end]
                for step in reversed(back):
                    path.append(int(step[path[-1]]))
                roles += [ROLES[s] for s in reversed(path)]
            keep = t.select(["conv", "seq"]).combine_chunks()
            yield pa.RecordBatch.from_arrays([keep.column("conv").combine_chunks(), keep.column("seq").combine_chunks(), pa.array(roles, pa.string())], ["conv", "seq", "parsed"])

    return scan


def parse(blocks: DataFrame, model: Model | None = None) -> DataFrame:
    """(conv_id, turn, seq, parsed, body) for blocks with (conv_id, turn, text);
    with no model, one is fit on the blocks' ``role`` outside the held-out part."""
    known = cut(features(blocks), "blocks")
    model = model or fit(known.where(~held_out()))
    slim = known.select("conv", "run", "seq", *FEATURES)
    sorted_ = slim.repartition("conv", "run").sortWithinPartitions("conv", "run", "seq")
    matrices = sorted_.mapInArrow(_matrices(model), "conv string, run long, m array<double>")
    ends = cut(_fold(matrices), "runs")
    ready = slim.join(ends, ["conv", "run"]).repartition("conv", "run").sortWithinPartitions("conv", "run", "seq")
    parsed = ready.mapInArrow(_decode(model), "conv string, seq long, parsed string")
    out = known.join(parsed, ["conv", "seq"])
    return out.select("conv_id", "turn", "seq", *[c for c in ("role",) if c in known.columns], "parsed", F.coalesce(stripped(F.col("text")), F.lit("")).alias("body"))


def render(parsed: DataFrame) -> DataFrame:
    """Canonical turns: (conv_id, seq, parsed, rendered), one row per block.

    A block opens with its role unless the block before has the same one, and
    closes unless the next has; joined in order they are the conversation.
    """
    own = parsed.withColumn("c", conversation())
    key = own.select("c", "seq", "parsed")
    was = key.select("c", (F.col("seq") + 1).alias("seq"), F.col("parsed").alias("was"))
    will = key.select("c", (F.col("seq") - 1).alias("seq"), F.col("parsed").alias("will"))
    own = own.join(was, ["c", "seq"], "left").join(will, ["c", "seq"], "left")
    opened = F.when(F.col("was").isNull() | (F.col("was") != F.col("parsed")), F.concat(F.lit("<|"), F.col("parsed"), F.lit("|>\n"))).otherwise("\n")
    closed = F.when(F.col("will").isNull() | (F.col("will") != F.col("parsed")), F.lit("<|end|>\n")).otherwise("")
    return own.select("conv_id", "turn", "seq", *[c for c in ("role",) if c in parsed.columns], "parsed", F.concat(opened, F.trim("body"), closed).alias("rendered"))


def transcripts(lines: DataFrame) -> DataFrame:
    """Blocks (conv_id, turn, text) of whole transcripts (conv_id, text): a new
    block begins at each line with a speaker marker."""
    split = lines.select("conv_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n(?=\s*(?:<\|\w+\|>|#{1,4}\s*\w+\s*:?(?:\n|$)|\[\w+\]|\**\w+\**\s*:))", "\u0001"), "\u0001")).alias("turn", "text"))
    return split.select("conv_id", F.col("turn").cast("long").alias("turn"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations with its recovered role and rendering."""
    with scratch(spark) as own_scope:
        out = own_scope.keep(render(parse(table(spark, sf_dir, "conversations"))), "turns")
    return out.select("conv_id", "turn", held_out().alias("held_out"), F.col("parsed").alias("role"), (F.col("parsed") == F.col("role")).alias("agrees"), "rendered")
