"""Quality scores and piecewise fingerprints against plain Python that shares no code with them."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from causeway.llm import fingerprints, quality
from test_ops import DOCS, corpus, prose

M = (1 << 64) - 1


# ------------------------------------------------------------------- 5
def plain_statistics(text):
    b = (text or "").encode()
    if not b:
        return dict.fromkeys(quality.STATS, 0.0)
    share = lambda chars: sum(c in chars for c in b) / len(b)
    w = re.findall(rb"[^\x20\x09-\x0d]+", b.lower())
    pairs = list(zip(w, w[1:]))
    lines = b.split(b"\n")
    return {
        "log_bytes": math.log(1 + len(b)), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share(b"0123456789"), "bang": share(b"!"), "bar": share(b"|"), "sign": share(b"#$%&*@~^<>=+_\\"),
        "other_punct": share(b".,;:?'\"-()[]{}/`"), "space": share(b" \t\n\x0b\x0c\r"), "word_bytes": sum(map(len, w)) / len(w) if w else 0.0, "longest_word": float(max(map(len, w), default=0)),
        "distinct_words": len(set(w)) / len(w) if w else 0.0, "top_word": max(Counter(w).values(), default=0) / max(len(w), 1), "distinct_pairs": len(set(pairs)) / len(pairs) if pairs else float(bool(w)),
        "line_bytes": len(b) / len(lines), "distinct_lines": len(set(lines)) / len(lines),
    }


def plain_score(model, text):
    own = plain_statistics(text)
    z = model.base
    for rule, weight in model.rules:
        if all((own[t.stat] > t.at) if t.above else (own[t.stat] <= t.at) for t in rule):
            z += weight
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 != 0
        text = "\n".join(prose(rng, 12).capitalize() + "." for _ in range(3)) if good else "BUY|" + prose(rng, 20).replace(" ", "*** ") + "!!1"
        rows.append((i, text))
        labels.append((i, int(good), 0))
    odd = [(1000 + k, t) for k, (_, t, *_) in enumerate(corpus())] + [(2000, "a"), (2001, "\n\n"), (2002, "A\tB\x0bA\x0cB"), (2003, "é È 日本"), (2004, "x" * 70_000)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict([*rows, *odd])


def test_scores_equal_plain_rules(labelled):
    docs, labels, texts = labelled
    model = quality.fit(docs, labels)
    assert len(model.rules) > 3
    got = {r.row.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert got[d] == pytest.approx(plain_score(model, t), abs=1e-12), t


def test_quality_stage_keeps_what_plain_rules_keep(spark, labelled, tmp_path):
    docs, labels, texts = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(docs, labels)
    want = sorted(d for d, t in texts.items() if plain_score(model, t) >= 0.3)
    assert sorted(r.doc_id for r in P.quality_filter(spark, docs, str(tmp_path)).collect()) == want
    assert 200 < len(want) < len(texts) - 100


# ------------------------------------------------------------------ 10
def mixed(x):
    x ^= x >> 31
    x = x * 0x9FB21C651E98DF25 & M
    x ^= x >> 28
    return (x * 0xD6E8FEB86659FD93 & M) ^ x >> 33


def plain_fingerprint(b):
    """Rolling hash over seven bytes, cuts where its low bits are ones, a character for each piece."""
    value = [mixed((c + 1) * 0x9E3779B97F4A7C15 & M) for c in range(256)]

    def rolling(end):
        x = sum((value[b[end - k]] & 0xFFFFFFFF) * pow(0x2C9277B5, k, 1 << 32) for k in range(7)) & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x85EBCA6B & 0xFFFFFFFF
        return x ^ x >> 13

    roll = {k + 1: rolling(k) for k in range(6, len(b))}
    cuts = lambda size: [k for k, x in roll.items() if x % size == size - 1]

    def signature(size):
        at = [0, *cuts(size)]
        if at[-1] < len(b) or len(at) == 1:
            at.append(len(b))
        out = ""
        for i, j in zip(at, at[1:]):
            h, scale = 0, 1
            for c in b[i:j]:
                h, scale = (h + value[c] * scale) & M, scale * 0x5851F42D4C957F2D & M
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[mixed(h) >> 58]
        return out

    size = 4
    while size * 64 < len(b) or len(cuts(size)) > 128:
        size *= 2
    while size > 4 and len(cuts(size)) < 32 and len(cuts(size // 2)) <= 128:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def plain_same(x, y):
    """By the edit distance with insertions and deletions, row by row."""
    k = min(4, len(x), len(y))
    if x != y and not {x[i : i + k] for i in range(len(x) - k + 1)} & {y[i : i + k] for i in range(len(y) - k + 1)}:
        return 0.0
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        was, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            was, row[j] = row[j], was if c == d else 1 + min(row[j], row[j - 1])
    return 1 - row[-1] / (len(x) + len(y)) if x or y else 1.0


def plain_likeness(x, y):
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    sides = {int(a): a1, 2 * int(a): a2}, {int(b): b1, 2 * int(b): b2}
    return max((plain_same(sides[0][s], sides[1][s]) for s in sides[0] if s in sides[1]), default=0.0) if x != y else 1.0


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = corpus()
    rows = [r for r in rows if len(r[1] or "") < 3000]
    base = prose(rng, 250)
    rows += [(200 + k, base[: 40 * k] + prose(rng, k) + base[40 * k :], None, None, None, 0, "k") for k in range(8)]
    rows += [(300, "abc", None, None, None, 0, "k"), (301, "aaaaaaa", None, None, None, 0, "k"), (302, "z" * 900, None, None, None, 0, "k")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    one = lambda t: prints.setdefault(t, plain_fingerprint(t.encode()))
    likes = []
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), one(t), one(edited)), t
        assert r.near_edited == pytest.approx(plain_likeness(one(t), one(edited)), abs=1e-12)
        assert r.near_next == pytest.approx(plain_likeness(one(t), one(nxt)), abs=1e-12)
        likes.append(r.near_edited)
    assert len(set(likes)) > 5
