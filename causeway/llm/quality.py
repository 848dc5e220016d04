"""Quality classification by a sparse rule ensemble.

Statistics of a text (shares of kinds of characters, repetition of words and
lines, lengths) feed shallow trees; every path from a root becomes a conjunction
of threshold tests, and a lasso logistic regression keeps few of them. The
result is compiled into one Spark column expression over the statistics.

The trees and the regression (Spark ML) are fit on at most about ``SAMPLE_ROWS``
labelled documents, drawn by hash from those whose crc32(doc_id) mod 5 is not 0;
all documents are scored. Only the text is an input of the score.

Defined cases: texts of any length are read whole; repeated rows are scored each by
itself, and ties of score stay ties; null and empty texts have statistics of 0 and are scored like
any other; several labels of one document are averaged; null labels are not
learned from; with no labelled documents, or labels of one kind only, the score
is the label mean (0.5 without labels); an empty table gives an empty result;
extra columns stay in ``row`` untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from causeway.llm.common import chunks, cut, mix, table, text_bytes, words, wrapped

SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 20, 3, 0.0005
THRESHOLD = 0.3
STATS = ["log_bytes", "upper", "digit", "bang", "bar", "sign", "other_punct", "space", "word_bytes", "longest_word", "distinct_words", "top_word", "distinct_pairs", "line_bytes", "distinct_lines"]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``STATS`` for each text."""
    out = np.zeros((len(offs) - 1, len(STATS)))
    kind = np.zeros((256, 7))
    kind[65:91, 0] = 1
    kind[48:58, 1] = 1
    kind[ord("!"), 2] = kind[ord("|"), 3] = 1
    kind[[ord(c) for c in "#$%&*@~^<>=+_\\"], 4] = 1
    kind[[ord(c) for c in ".,;:?'\"-()[]{}/`"], 5] = 1
    kind[[9, 10, 11, 12, 13, 32], 6] = 1
    for a, b in chunks(offs):
        row, start, end, h = words(data, offs[a : b + 1])
        at = np.searchsorted(row, np.arange(b - a + 1))
        size = end - start
        for i in range(b - a):
            d = data[offs[a + i] : offs[a + i + 1]]
            if not len(d):
                continue
            o = out[a + i]
            count = np.bincount(d, minlength=256)
            o[0] = np.log1p(len(d))
            o[1:8] = count @ kind / len(d)
            w = h[at[i] : at[i + 1]]
            if len(w):
                s = size[at[i] : at[i + 1]]
                _, n = np.unique(w, return_counts=True)
                o[8], o[9], o[10], o[11] = s.mean(), s.max(), len(n) / len(w), n.max() / len(w)
                o[12] = len(np.unique(mix(w[:-1]) + w[1:])) / (len(w) - 1) if len(w) > 1 else 1.0
            lines = d.tobytes().split(b"\n")
            o[13], o[14] = len(d) / len(lines), len(set(lines)) / len(lines)
    return out


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _stats(text: pa.Array) -> pa.Array:
    got = statistics(*text_bytes(text))
    return pa.StructArray.from_arrays([pa.array(got[:, i].copy()) for i in range(len(STATS))], names=STATS)


# ---------------------------------------------------------------- rules
@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    at: float

    def column(self, stat) -> Column:
        c = stat(self.stat)
        return c > F.lit(self.at) if self.above else c <= F.lit(self.at)


Rule = tuple[Test, ...]


def paths(tree_text: str) -> list[Rule]:
    """All paths of a tree's printed form, inner nodes included."""
    out, stack = [], []
    for line in tree_text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, Test(STATS[int(m[3])], m[4] == ">", float(m[5]))))
            out.append(tuple(t for _, t in stack))
    return out


def simplified(rule: Rule) -> Rule:
    """One bound each way for each statistic."""
    best: dict[tuple[str, bool], float] = {}
    for t in rule:
        k = (t.stat, t.above)
        best[k] = t.at if k not in best else (max if t.above else min)(best[k], t.at)
    return tuple(Test(s, above, at) for (s, above), at in sorted(best.items()))


@dataclass
class Ensemble:
    base: float
    rules: list[tuple[Rule, float]]

    def score(self, stat) -> Column:
        """Probability of label 1; ``stat`` gives the column of a statistic."""
        z = F.lit(self.base)
        for rule, weight in self.rules:
            test = rule[0].column(stat)
            for t in rule[1:]:
                test = test & t.column(stat)
            z = z + F.when(test, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).alias("y")).where(~held_out())
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 50)) < int(sample_rows / n * (1 << 50)))
    # the sample is bounded by the parameter, so it can go to every task
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("y", _stats("text").alias("s")).select("y", "s.*")
    sample = cut(sample, "sample").coalesce(4)
    got = sample.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    if not got.n or got.y in (0.0, 1.0):
        mean = min(max(got.y if got.n else 0.5, 0.001), 0.999)
        return Ensemble(float(np.log(mean / (1 - mean))), [])
    vectors = VectorAssembler(inputCols=STATS, outputCol="x").transform(sample).select("y", "x").persist()
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7).fit(vectors)
    vectors.unpersist()
    rules = sorted({simplified(r) for t in forest.trees for r in paths(t.toDebugString)}, key=repr)
    if not rules:
        return Ensemble(float(np.log(got.y / (1 - got.y))), [])
    tests = []
    for rule in rules:
        c = rule[0].column(F.col)
        for t in rule[1:]:
            c = c & t.column(F.col)
        tests.append(c.cast("double"))
    table_ = sample.select("y", F.array(*tests).alias("r"))
    from pyspark.ml.functions import array_to_vector

    table_ = table_.select("y", array_to_vector("r").alias("x")).persist()
    lasso = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(table_)
    table_.unpersist()
    return Ensemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w])


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, with its score."""
    stats = wrapped(docs).withColumn("s", _stats("row.text"))
    return stats.select("row", model.score(lambda s: F.col(f"s.{s}")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
