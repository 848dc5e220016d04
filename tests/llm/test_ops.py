"""The numbered operators against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import chat, common, ctw, fingerprints, linededup, mixing, neardup, packing, quality, sharding, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _score int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus():
    """Copies, near copies, shared lines, odd and empty texts, nulls, ties."""
    rng = random.Random(5)
    texts = [prose(rng, 60) + "\n" + prose(rng, 12) + ".\nA shared line of text\n" + prose(rng, 20) for _ in range(12)]
    for k in range(8):  # near copies of the first
        w = texts[0].split(" ")
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], texts[1].upper(), "", None, " \t\n ", "one", "one", "one two", "é" * 9, "É" * 12 + "\n" + "É" * 12, "x  y\n\n z ", "  lead\r\nA SHARED line of text  \t", "a" * 30_000, prose(rng, 4000), "日本 語 テキスト\x85  ' s"]
    return [(i * 3 % 97, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, None, i, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------- 1
def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_components(rows, k, percent):
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("scheme", [neardup.STRICT, neardup.Scheme()])
def test_near_duplicates(docs, rows, scheme):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, scheme).collect()}
    assert got == brute_components(rows, scheme.words, scheme.percent)


def test_near_duplicates_of_odd_rows(spark, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (None, " ")], "doc_id long, text string")
    got = neardup.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("7", "7", True), ("8", "8", True), *[("None", "None", False)] * 3]


def test_equal_ids_with_different_texts(spark):
    """Rows are documents of their own: no text is lost, none stays twice."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, c), (None, c), (9, None), (9, None), (5, a + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(3, True, 3, True): 1, (5, True, 3, False): 2, (5, True, 5, True): 2, (None, True, 5, False): 1, (None, True, None, False): 2, (9, False, 9, True): 2})
    left = neardup.one_of_each(df).collect()
    assert sorted(map(str, left)) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (None, c), (9, None), (9, None)], "doc_id long, text string").collect()))


def test_large_families_go_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = prose(rng, 80).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(neardup, "KEY_ROWS", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.STRICT).collect()}
    assert got == brute_components(rows, 3, 85)


def test_all_pairs_within_the_threshold_share_a_key():
    rng = np.random.default_rng(0)
    s = neardup.STRICT
    for _ in range(200):
        wrong = rng.choice(s.slots, s.most, replace=False)
        # some chunk has at most one wrong slot, so the key that leaves it out is equal
        assert any(sum(a <= w < b for w in wrong) <= 1 for a, b in s.spans())


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((2, 1), (50, 40), (200, 190)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 30)]
        got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        label = common.local_components(n + 31, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert all(label[k] == v for k, v in got.items())
        assert {k for p in pairs if p[0] != p[1] for k in p} == set(got)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_words():
    texts = ["Aa bb\tCC\n\x0bdd", "", "É é", "aA  BB cc", "x"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, start, end, h = common.words(np.frombuffer(data, np.uint8), offs)
    got = [(int(r), data[a:b].decode()) for r, a, b in zip(row, start, end)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    by = defaultdict(set)
    for (_, w), x in zip(got, h):
        by[w.translate(LOWER)].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# ------------------------------------------------------------------- 2
def brute_lines(rows):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    out = {}
    for d, t, *_ in rows:
        xs = (t or "").split("\n")
        kept = [x for x in xs if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out[d] = (len(xs), len(xs) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, rows, nothing):
    out = linededup.rebuilt(docs)
    assert {r.row.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in out.collect()} == brute_lines(rows)
    assert linededup.dedup_lines(docs).columns == docs.columns and linededup.dedup_lines(nothing).count() == 0


def test_lines_beyond_the_small_arrays(docs):
    """The small arrays only spare a way; without them the hits are the same."""
    def gone(most):
        return {r.doc: sorted(r.gone) for r in linededup.drops(docs, small_keys=most).collect()}

    assert gone(0) == gone(1 << 20) != {}


def test_lines_of_equal_ids(spark):
    """Rows of one doc_id are one document: their common line stays in both."""
    rows = [(5, "the first common line\nown a"), (5, "the first common line\nown b"), (7, "THE FIRST common line \nown c"), (None, "the first common line"), (None, "only of nulls, twice")] + [(None, "only of nulls, twice")]
    got = sorted((str(r.row.doc_id), r.text, r.n_dropped) for r in linededup.rebuilt(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", rows[0][1], 0), ("5", rows[1][1], 0), ("7", "own c", 1), ("None", "", 1), *[("None", "only of nulls, twice", 0)] * 2])


def test_hot_lines_are_salted(spark):
    rows = [(i, f"the same line everywhere\nown line {i:09}") for i in range(3000)]
    got = linededup.rebuilt(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped = 1").count()
    assert got == 2999


def test_minimal_perfect_hash():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    levels = linededup.mph_build(keys)
    assert sorted(linededup.mph_index(levels, keys)) == list(range(len(keys)))


# ------------------------------------------------------------------- 3
def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {d: np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), 0).astype("<u4") for d, t, *_ in rows}
    got = packing.pack_documents(docs, group_docs=16).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [*((sorted(p), len(want[d])) for d, p in by_doc.items()), *((sorted(p), None) for p in by_seq.values())]:
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        size = sum(n for _, n in pieces)
        assert size == total if total else size <= 1024 and size & (size - 1) == 0
    assert set(by_doc) == set(want)
    assert packing.pack_documents(nothing).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(4)
    for n in (1, 2, 7, 300):
        sizes = sorted((rng.randint(1, 1023) for _ in range(n)), reverse=True)
        bins = []
        tree = packing.Bins(n, 1024)
        for s in sizes:
            want = next((i for i, b in enumerate(bins) if b + s <= 1024), len(bins))
            assert tree.put(s) == want
            bins[want:] = [bins[want] + s if want < len(bins) else s, *bins[want + 1 :]]
        seqs = packing.pack(sizes, 1024)
        ids = Counter(i for q in seqs for item, a, m in q for i in [(item, x) for x in range(a, a + m)])
        assert len(ids) == sum(sizes) and set(ids.values()) == {1}


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())  # untouched
    enc = packing.Encoder(packing.default_tokenizer())
    assert enc.fast is not None
    rng = random.Random(6)
    pools = [range(32, 127), [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x3000, 0x1C, 0x200B, 0xFEFF], range(0xA0, 0x250), range(0x3000, 0xD7FF), range(0x10000, 0x20000), [39, 115, 116]]
    for _ in range(3000):
        t = "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 14)))
        assert enc(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
    for n in (packing.LONG - 1, packing.LONG, packing.LONG + 1):
        t = (prose(rng, 60) + " \n") * (n // 100)
        t = (t + "x" * n)[:n]
        assert enc(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()


def test_added_tokens_are_one_id(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.Encoder(packing.default_tokenizer())
    end = "<|endoftext|>"
    assert tok.token_to_id(end) in np.frombuffer(enc(f"a {end}b"), "<u2")
    for long in (packing.LONG, 20):
        monkeypatch.setattr(packing, "LONG", long)
        for t in (end, f"a {end}b", f"{end}{end} x\n{end}", "plain text, no token at all <|endoftext |>", f" {end} " * 9, end.upper()):
            assert enc(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()


# ------------------------------------------------------------------- 4
def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.05, 0.12])
        rows.append((i, [float(x) for x in v * rng.uniform(0.5, 2)], i % 2))
    rows += [(200 + i, rows[3][1], 1) for i in range(5)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [None] * 8, 1), (304, rows[3][1], None), (305, [float("inf")] * 8, 0), (306, [1.0, 2.0], 1), (307, [1.0, 2.0], 1), (308, [], 1)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), pivot_rows=12).collect()
    ok = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if v and c is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a, x, c in ok:
        for b, y, e in ok:
            if a != b and c == e and len(x) == len(y) and x @ y >= 0.98:
                links[a].add(b)

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (len(links[i]), low(i), low(i) == i) for i, *_ in rows}
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_visits_miss_no_partner():
    """Visits per vector for more and more pivots, with and without clusters."""
    rng = np.random.default_rng(11)
    radius = math.sqrt(2 - 2 * 0.98)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = unit(rng.normal(size=(3000, 64)))
    tight = unit(unit(rng.normal(size=(50, 64)))[rng.integers(0, 50, 3000)] + 0.02 * rng.normal(size=(3000, 64)))
    for x, most in ((spread, {10: 0.8, 100: 0.5, 1000: 0.2}), (tight, {10: 0.8, 100: 0.5, 1000: 0.05})):
        y = unit(x + 0.02 * rng.normal(size=x.shape))
        near = (x * y).sum(axis=1) >= 0.98
        assert near.sum() > 100
        for n in (10, 100, 1000):
            p = x[rng.choice(len(x), n, replace=False)]
            home, row, cell = vectors.visits(x, p, radius)
            print(f"{n} pivots: {len(row) / len(x):.1f} cells a vector")
            assert len(row) / len(x) <= 1 + most[n] * n
            held = set(zip(row.tolist(), cell.tolist()))
            other = vectors.visits(y, p, radius)[0]
            assert all((i, int(other[i])) in held for i in np.flatnonzero(near))


# ------------------------------------------------------------------- 5
def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, 40)
        rows.append((i, text.capitalize() + "." if good else text.replace(" ", "*** ")))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("_s2", quality.F.lit(1))
    lab = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    out = {r.row.doc_id: r.score for r in quality.scored(df, model).collect()}
    assert set(out) == {r[0] for r in rows} | {900, 901} and all(0 <= s <= 1 for s in out.values())
    held = [(out[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    assert out[900] == out[901]
    none = quality.fit(df, lab.where("false"))
    assert quality.scored(df, none).first().score == pytest.approx(0.5)
    assert quality.scored(df.where("false"), model).count() == 0


def test_tree_paths():
    text = "  Tree\n    If (feature 0 <= 1.5)\n     If (feature 2 > 0.5)\n      Predict: 0.0\n     Else (feature 2 <= 0.5)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0"
    got = [tuple((t.stat, t.above, t.at) for t in p) for p in quality.paths(text)]
    a, b = quality.STATS[0], quality.STATS[2]
    assert got == [((a, False, 1.5),), ((a, False, 1.5), (b, True, 0.5)), ((a, False, 1.5), (b, False, 0.5)), ((a, True, 1.5),)]


# ------------------------------------------------------------------- 6
def test_sharding(spark, docs, rows, tmp_path, nothing):
    t = sharding.ShardedTable(spark, f"file://{tmp_path}/t", target=200_000, smallest=50_000, fanout=3)
    for batch in sharding.arrivals(docs, 5):
        t.append(batch.coalesce(1))
    t.append(nothing)
    before = t.manifest()
    m = t.compact()
    assert before.version == 6 and m.version > 6 and len(m.shards) < len(before.shards)
    assert not t.plan(m)
    for v in (None, 6):
        assert sorted(map(str, t.read(v).drop("_shard").collect())) == sorted(map(str, docs.collect()))
    assert sum(s.rows for s in m.shards) == len(rows)
    with pytest.raises(Exception):
        t._commit(before)  # the version exists
    assert t.vacuum(keep=2) == 0  # all are young
    assert t.vacuum(keep=1, older_than=0) > 0 and t.versions() == [m.version]
    assert sorted(map(str, t.read().drop("_shard").collect())) == sorted(map(str, docs.collect()))


def test_shards_of_new_columns_and_odd_folders(spark, tmp_path):
    t = sharding.ShardedTable(spark, f"file://{tmp_path}/a b%20c", fanout=2)
    assert t.append(spark.createDataFrame([], "doc_id long, text string")).shards == [] and t.read().count() == 0
    t.append(spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string").coalesce(1))
    t.append(spark.createDataFrame([("y" * 3_000_000, 2, 0.5)], "text string, doc_id long, _metadata double"))
    m = t.compact()
    assert [(s.rows, s.merged) for s in m.shards] == [(4, 1)]
    rows = t.read().collect()
    assert sorted((r.doc_id or 0, len(r.text or ""), r._metadata) for r in rows if r._metadata is None) == [(0, 0, None), (1, 1, None), (1, 1, None)]
    assert [(r.doc_id, len(r.text)) for r in rows if r._metadata == 0.5] == [(2, 3_000_000)]
    assert {r._shard for r in rows} == {s.path for s in m.shards}
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("1",)], "doc_id string"))


def test_sharding_query(spark, docs, rows, tmp_path):
    """The registered query: every row once, and shards that add up."""
    docs.unionAll(docs.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = sharding.query(spark, str(tmp_path)).collect()
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.n_bytes, r.sha256) for r in got) == Counter((r.doc_id, None if r.text is None else len(r.text.encode()), sha(r.text)) for r in stored)
    held = Counter(r.shard for r in got)
    assert all(held[r.shard] == r.shard_rows and r.shard_bytes > 0 and r.born <= r.version for r in got)
    assert len({r.version for r in got}) == 1 and got[0].version > sharding.ARRIVALS and max(r.merges for r in got) >= 1
    small = [s for s in {(r.shard, r.shard_bytes) for r in got} if s[1] < sharding.SMALLEST_BYTES]
    assert len(small) < sharding.FANOUT


# ------------------------------------------------------------------- 7
def test_scores(docs, rows, nothing, spark):
    got = {r.doc_id: r for r in ctw.score_documents(docs, ~ctw.held_out(), common=8, common_grams=300).collect()}
    tokens = {d: [*words(t), "\0"] for d, t, *_ in rows}
    c = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert ctw.score_documents(nothing, ~ctw.held_out()).count() == 0
    untrained = ctw.score_documents(docs, ctw.F.lit(False))
    assert untrained.where("n_known > 0 or score is null").count() == 0
    # nothing is known, so a byte costs eight bits
    assert {r.doc_id: r.score for r in untrained.collect()} == pytest.approx({d: 8 * math.log10(0.5) * (sum(len(w.encode()) + 1 for w in words(t)) + 1) for d, t, *_ in rows})


def brute_tree(texts, depth):
    """Scores of (text, trained) by the definition: the root's mixture of
    Krichevsky-Trofimov estimates over the whole sequence of bytes."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        past = b"\n" * depth
        for x in b"".join(w.encode() + b" " for w in words(text)) + b"\n":
            for k in range(8):
                yield past[::-1][:depth], (x | 256) >> (8 - k), x >> (7 - k) & 1
            past = past[1:] + bytes([x])

    for text, trained in texts:
        for past, node, bit in decisions(text):
            for d in range(depth + 1):
                counts[past[:d], node][bit] += trained

    children = defaultdict(list)
    for ctx, node in list(counts):
        if ctx:
            children[ctx[:-1], node].append(ctx)

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(counts[ctx, node])
            if len(ctx) == depth:
                memo[ctx, node] = own, 1.0
            else:
                below = sum(weighted(c, node)[0] for c in children[ctx, node])
                top = max(own, below)
                memo[ctx, node] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2), 1 / (1 + math.exp(below - own))
        return memo[ctx, node]

    def p(past, node, bit):
        out, left, best = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            n = counts[past[:d], node]
            if not sum(n):
                return best  # no observations from here on: the deepest context that has some
            e, share = (n[bit] + 0.5) / (sum(n) + 1), weighted(past[:d], node)[1]
            best = out + left * e
            out, left = out + left * share * e, left * (1 - share)
        return out

    return [sum(math.log10(p(*x)) for x in decisions(text)) for text, _ in texts]


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_tree_weighting_equals_a_recursion(spark, depth):
    texts = [("abab abba  Ab", 1), ("abba cab\n b", 1), ("", 1), (None, 0), ("abab bac é zz", 0), ("abab abba ab", 1), ("q", 0)]
    df = spark.createDataFrame([(i, t, bool(x)) for i, (t, x) in enumerate(texts)], "doc_id long, text string, own boolean").repartition(3)
    want = brute_tree([(t, x) for t, x in texts], depth)
    for most in (0, 5, 1 << 20):  # grams beyond the broadcast are joined
        got = {r.doc_id: r.score for r in ctw.score_documents(df, ctw.F.col("own"), depth, most, most).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_frequent_contexts_are_dealt_deeper(spark):
    """Groups stay within their bound, and the values don't depend on it."""
    rng = random.Random(21)
    texts = [(i, "the " * 40 + prose(rng, 60) if i % 3 else prose(rng, 80), i % 4 > 0) for i in range(24)]
    df = spark.createDataFrame(texts, "doc_id long, text string, train boolean").select("text", "train")
    depth = 6
    counted = df.mapInArrow(ctw._counts(depth), "kind long, key long, n long, c long").where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).persist()
    want = {r.gram: (r.m, r.lp) for r in ctw.tree(counted, depth, 1 << 40).collect()}
    assert ctw.dealt_grams(counted, depth, 1 << 40)[1] == ctw.TOP
    for group in (1, 6, 40):
        dealt, last = ctw.dealt_grams(counted, depth, group)
        assert ctw.TOP < last <= depth - 1
        sizes = dealt.groupBy("top", "ctx").count().collect()
        assert all(r["count"] <= group for r in sizes if r.top < depth - 1) and sum(r["count"] for r in sizes) == len(want)
        got = {r.gram: (r.m, r.lp) for r in ctw.tree(counted, depth, group).collect()}
        assert {k: m for k, (m, _) in got.items()} == {k: m for k, (m, _) in want.items()}
        assert {k: x for k, (_, x) in got.items()} == pytest.approx({k: x for k, (_, x) in want.items()})


def test_probabilities_sum_to_one(spark):
    """Over all next bytes of a context; contexts cross words."""
    rng = random.Random(12)
    texts = [(i, prose(rng, 30), True) for i in range(20)]
    probe = [(100 + b, "ab ef" + chr(b), False) for b in (*range(97, 105), 33, 126)]
    df = spark.createDataFrame(texts + probe, "doc_id long, text string, own boolean")
    counted = df.mapInArrow(lambda it: ctw._counts(4)(x.rename_columns(["doc_id", "text", "train"]).select(["text", "train"]) for x in it), "kind long, key long, n long, c long").where("kind = 1").groupBy("key").agg(ctw.F.sum("n").alias("n"), ctw.F.sum("c").alias("c"))
    lp = defaultdict(dict)
    for r in ctw.tree(counted, 4).collect():
        lp[r.gram >> 8][r.gram & 255] = r.lp
    assert all(sum(10**x for x in own.values()) <= 1 + 1e-9 for own in lp.values())
    assert any(0x20 in (k >> 8 & 255, k >> 16 & 255) for k in lp)


def test_rare_bits_of_common_contexts_are_finite(spark):
    """A byte that is not trained on, against 10^12 observations of another."""
    many = 10**12
    counted = spark.createDataFrame([(0x0A0A61, many, many), (0x0A0AE1, 1, 0)], "key long, n long, c long")
    lp = {r.gram & 255: r.lp for r in ctw.tree(counted, 2).collect()}
    # the first bit of 0xe1 was never seen in any context, the others in none
    assert lp[0xE1] == pytest.approx(math.log10(0.5 / (many + 1)) + 7 * math.log10(0.5), abs=0.4)
    assert all(math.isfinite(x) for x in lp.values())


def test_held_out_text_is_coded_better_than_by_words(spark):
    """Words that lean on the word before, which a model of single words can't see."""
    rng = random.Random(13)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = []
    for i in range(300):
        at = rng.randrange(40)
        text = []
        for _ in range(40):
            text.append(names[at])
            at = (at * 7 + rng.choice((1, 2, 3))) % 40
        rows.append((i, " ".join(text)))
    got = ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), ~ctw.held_out()).where("not train").collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


# ------------------------------------------------------------------- 8
def turns(n):
    rng = random.Random(9)
    out = []
    for c in range(n):
        if c % 3 == 0:
            out.append((c, 0, "system", "be " + prose(rng, 8)))
        for t in range(1, 1 + 2 * rng.randint(1, 3)):
            out.append((c, t, "user" if t % 2 else "assistant", prose(rng, 5) + "?" if t % 2 else prose(rng, 60)))
    return out


def test_roles(spark):
    df = spark.createDataFrame(turns(80), "conv_id long, turn long, role string, text string")
    got = chat.parse(df).collect()
    assert np.mean([r.parsed == r.role for r in got]) > 0.97


@pytest.mark.parametrize("fan", [256, 2, 3])
def test_long_conversations_decode_in_runs(spark, monkeypatch, fan):
    """Runs joined at their borders give the path of one Viterbi pass, whatever the levels of the fold."""
    monkeypatch.setattr(chat, "RUN", 4)
    monkeypatch.setattr(chat, "FAN", fan)
    df = spark.createDataFrame([*turns(30), *[(99, t, None, f"{'x ' * (t % 5)}?" if t % 3 else None) for t in range(37)]], "conv_id long, turn long, role string, text string")
    known = chat.features(df).orderBy("conv", "seq")
    model = chat.fit(known)
    got = {(r.conv_id, r.turn): r.parsed for r in chat.parse(df, model).collect()}
    rows = known.where("conv_id = 99").toArrow()
    e = model.scores(rows)
    best, back = model.start + e[0], []
    for x in e[1:]:
        whole = best[:, None] + model.step
        back.append(whole.argmax(axis=0))
        best = whole.max(axis=0) + x
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    assert [got[99, t] for t in range(37)] == [chat.ROLES[s] for s in reversed(path)]


def test_turns_of_one_place(spark):
    """Null and equal turns, null and empty conv_ids: every row keeps a place of its own."""
    rows = [(None, None, "user", f"line {i % 50}") for i in range(300)] + [("", 1, "assistant", f"line {i}") for i in range(200)] + [("a", i % 3, "user", "same") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    got = defaultdict(list)
    for r in chat.features(df).collect():
        got[r.conv_id].append((r.seq, r.turn))
    assert {c: sorted(s for s, _ in x) for c, x in got.items()} == {None: list(range(300)), "": list(range(200)), "a": list(range(30))}
    assert [t for _, t in sorted(got["a"])] == [0] * 10 + [1] * 10 + [2] * 10
    assert chat.render(chat.parse(df)).count() == len(rows)


def test_turns_with_columns_of_internal_names(spark):
    rows = turns(12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv", "hash", "at", "range", "n", "first", "base", "seq", "run", "g", "m", "before", "end", "parsed", "body", "c", "was", "will", "rendered", *chat.FEATURES]
    odd = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    want = sorted(map(tuple, chat.render(chat.parse(df)).collect()))
    assert sorted(map(tuple, chat.render(chat.parse(odd)).collect())) == want


def test_rendering(spark):
    lines = spark.createDataFrame([(1, "System: be brief\nUser: hi\nthere\nAssistant: hello\nAssistant: again"), (2, None)], "conv_id long, text string")
    blocks = chat.transcripts(lines)
    assert blocks.where("conv_id = 1").count() == 4
    model = chat.Model({}, {}, {})
    out = chat.render(chat.parse(blocks, model)).orderBy("conv_id", "seq").collect()
    assert "".join(r.rendered for r in out if r.conv_id == 1) == "<|system|>\nbe brief<|end|>\n<|user|>\nhi\nthere<|end|>\n<|assistant|>\nhello\nagain<|end|>\n"
    assert chat.parse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    odd = spark.createDataFrame([(None, None, "user", None), (None, None, "user", ""), (1, 1, "user", "a"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.parse(odd)).count() == 4


# ------------------------------------------------------------------- 9
def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    size = {(d, i): len(WORD.findall(t or "")) for i, (d, t, *_) in enumerate(rows)}
    per = Counter()
    for (d, i), n in size.items():
        per[rows[i][3]] += n
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == per[r.source]
    target = {r.source: r.target for r in got}
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    assert sum(target.values()) == pytest.approx(1.5 * sum(per.values()))
    levels = {round(target[s] / weight[s], 6) for s in names if target[s] < 2 * per[s] - 1e-9}
    assert len(levels) <= 1 and all(target[s] <= 2 * per[s] + 1e-9 for s in names)
    assert all(taken[s] == math.floor(target[s]) for s in names)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, r.position)
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, again)))
    at = [r.position for r in got if r.position is not None]
    assert all(0 <= p <= 1 for p in at)
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns


def test_both_passes_have_positions(spark, docs, rows):
    """At a row's position its source's demand is the words dealt before it."""
    twice = [*rows, (None, "the same words", None, "s1", 0, 0, "k"), (None, "the same words", None, "s1", 0, 0, "k")]
    df = spark.createDataFrame([(r[0], r[1], r[3], i) for i, r in enumerate(twice)], "doc_id long, text string, source string, tag long")
    got = mixing.passes(df).collect()
    names = sorted({r[3] for r in twice if r[3] is not None}) + [None]
    assert {r["pass"] for r in got} == {1, 2}
    for k, s in enumerate(names):
        own = sorted((r for r in got if r.source == s), key=lambda r: (r["pass"], r.position))
        assert [r.position for r in own] == sorted(r.position for r in own)  # the second pass after the first
        tilt, before = 0.5 if k % 3 == 0 else -0.5, 0
        for r in own:
            assert r.target * ((1 - tilt) * r.position + tilt * r.position**2) == pytest.approx(before, abs=1e-6 * r.target)
            before += r.words
        assert before == math.floor(own[0].target)
    at = defaultdict(list)
    for r in got:
        at[twice[r.tag][0]].append(r.position)
    out = [r.doc_id for r in mixing.mixed_documents(df.drop("tag")).collect()]
    assert Counter(out) == {d: len(p) for d, p in at.items()}
    walk = {d: iter(sorted(p)) for d, p in at.items()}
    seen = [next(walk[d]) for d in out]
    assert seen == sorted(seen)


def test_mixing_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix(df).collect()] == [(0, 0), (0, 0)]


# ------------------------------------------------------------------ 10
def test_fingerprints(docs, rows, nothing):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    one = lambda t: fingerprints.fingerprints([t.encode()])[0]
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), one(t), one(edited))
        assert r.near_edited == fingerprints.likeness(one(t), one(edited)) and r.near_next == fingerprints.likeness(one(t), one(nxt))
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_likeness():
    rng = random.Random(10)
    text = prose(rng, 600)
    a, b, c = (fingerprints.fingerprints([t.encode()])[0] for t in (text, text.replace("a", "A", 3), prose(rng, 600)))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.8 and fingerprints.likeness(a, c) < 0.3
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    assert fingerprints.likeness("4:abc:ab", "64:abc:ab") == 0
