"""The stages on rows with odd values and names, against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from causeway.llm import packing, quality
from test_ops import DOCS, brute_components, brute_lines, corpus, words


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["row", "gone", "doc", "score", "s", "copies", "new", "size", "component_id", "kept"]
    df = spark.createDataFrame([*corpus(), (None, "a text without a number", None, None, 3, 1, "k")], DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(0, 97, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("k", range(len(P.STAGES) - 1))
def test_stages_keep_the_columns(spark, docs, sf, k):
    out = P.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns
    assert out.where("gone <> 1 or size <> 7 or copies <> 5").count() == 0
    assert P.STAGES[k][1](spark, docs.where("false"), sf).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, docs, sf):
    got = sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, sf).collect())
    comp = brute_components(corpus(), 5, 80)
    assert got == sorted([str(d) for d, (_, c) in comp.items() if d == c] + ["None"])


def test_line_dedup_takes_effect(spark, docs, sf):
    got = {r.doc_id: (r.text or "", r.n_chars) for r in P.line_dedup(spark, docs, sf).where("doc_id is not null").collect()}
    want = brute_lines(corpus())
    assert {d: t for d, (t, _) in got.items()} == {d: t for d, (_, _, t) in want.items()}
    assert all(n is None or n == len(t) for t, n in got.values())


def test_results_live_side_by_side(spark, docs, sf):
    """A stage leaves what another stage's result still reads."""
    one = P.near_dedup(spark, docs, sf)
    other = P.line_dedup(spark, docs.where("doc_id > 40"), sf)
    assert one.count() > 10 and 0 < other.count() < docs.count() and one.columns == other.columns


def test_quality_drops_by_score(spark, docs, sf):
    """The rows whose score, of a model fit anew, reaches the threshold."""
    model = quality.fit(docs, P.table(spark, sf, "labels"))
    want = Counter(str(r.row) for r in quality.scored(docs, model).collect() if r.score >= 0.3)
    assert Counter(str(r) for r in P.quality_filter(spark, docs, sf).collect()) == want


def brute_mix(rows):
    """Copies of each row by plain sums along the order of the documents' hashes."""
    size = [len(words(t)) for _, t, *_ in rows]
    per = defaultdict(list)
    for i, (d, t, _, source, *_) in enumerate(rows):
        per[source].append((hashlib.md5(":".join([*([str(d)] if d is not None else []), t or ""]).encode()).hexdigest(), d, size[i], i))
    names = sorted(s for s in per if s is not None) + [s for s in per if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    room = {s: 2 * sum(x[2] for x in per[s]) for s in names}
    low, high = 0.0, 1e9
    for _ in range(200):  # the common level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(room[s], level * weight[s]) for s in names) < 1.5 * sum(size) else (low, level)
    copies = Counter()
    for s in names:
        goal, dealt = math.floor(min(room[s], high * weight[s]) + 1e-6), 0
        for _ in range(2):
            for *_, n, i in sorted(per[s], key=lambda x: x[0]):
                copies[i] += dealt < goal and n > 0
                dealt += n
    return copies


def test_mixing_repeats_or_leaves_out(spark, docs, sf):
    rows = [*corpus(), (None, "a text without a number", None, None, 3, 1, "k")]
    want = Counter()
    for i, n in brute_mix(rows).items():
        if n:
            want[rows[i][:2]] += n
    assert Counter((r.doc_id, r.text) for r in P.mix_sources(spark, docs, sf).collect()) == want


def test_run(spark, docs, sf):
    """All stages in turn, each against its own input, and ids rebuilt from the pieces."""
    docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    out = P.run(spark, sf).collect()
    left = docs
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        left = spark.createDataFrame(stage(spark, left, sf).collect(), docs.schema)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want, got = Counter(), Counter()
    for r in left.collect():
        want[r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    for r in out:
        got[r.doc_id, r.doc_tokens] += r.length / r.doc_tokens
    assert {k: round(n, 6) for k, n in got.items()} == want
