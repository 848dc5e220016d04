"""Fill-in-middle, URL filter and phrases against plain Python on small tables."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from causeway.llm import infill, phrases, urlfilter

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CLASHES = ["row", "i", "n", "x", "form", "output", "pieces", "batch", "prefix_chars", "ends", "restored", "host", "path", "rule", "verdict", "terms", "block", "slot", "id", "a", "l", "word", "score"]


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


# ------------------------------------------------------------------ 11
def brute_infill(doc_id, text):
    """(n, form, prefix, middle, output) by slicing."""
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", "x", "é", "😀" * 63, "😀" * 64, "😀" * 65, "a\0b\r\n\u2028\x85c", "<P", "<S><M>", "a<P>b", "<<<S" * 99, "<P <S <M" * 5000, "e\u0301" * 700, "\n" * 130]
    texts += ["".join(rng.choice("ab<>PSM é😀\n") for _ in range(rng.randrange(300))) for _ in range(300)]
    return [(k if k % 50 else None, t) for k, t in enumerate(texts)] + [(7, "again"), (7, "again"), (7, "other"), (10**18, "long id"), (-5, "below")]


def test_infill_equals_slices(spark):
    rows = odd_texts()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = infill.infilled(docs).select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert Counter(map(tuple, out)) == Counter((d, t, *brute_infill(d, t)) for d, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_infill_restores_every_text(spark):
    docs = clashing(spark.createDataFrame(odd_texts(), "doc_id long, text string").drop("form"))
    out = infill.infilled(docs).select(F.col("row.text").alias("before"), "form", "output")
    back = infill.restored(out)
    assert back.count() == len(odd_texts())
    assert back.where("not output <=> coalesce(row.before, '')").count() == 0


def test_fill_in_middle_keeps_columns(spark):
    docs = clashing(spark.createDataFrame([(1, "some text here", 14)], "doc_id long, text string, n_chars long"))
    out = infill.fill_in_middle(docs)
    assert out.columns == docs.columns
    r = out.first()
    assert r.text == brute_infill(1, "some text here")[4] and r.n_chars == len(r.text) and r.form == CLASHES.index("form")
    assert infill.fill_in_middle(docs.where("false")).count() == 0


def test_infill_of_other_settings(spark):
    docs = spark.createDataFrame([(k, "it's a text" * 9) for k in range(60)], "doc_id long, text string")
    how = {"seed": "it's", "plain_from": 100, "spm_below": 100, "sentinels": ("<|pre'|>", "<|suf|>", "<|mid|>")}
    out = infill.infilled(docs, **how)
    assert {r.form for r in out.collect()} == {"spm"}
    assert out.where(r"output not like '<|suf|>%<|pre\'|>%<|mid|>%'").count() == 0
    back = infill.restored(out.select("form", "output"), how["sentinels"])
    assert {r.output for r in back.collect()} == {"it's a text" * 9}


def test_infill_query(spark, tmp_path):
    rows = odd_texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = Counter((d, n, form, p, m, sha(o), sha(t)) for d, t in rows for n, form, p, m, o in [brute_infill(d, t)])
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, infill.query(spark, str(tmp_path)).select(*cols).collect())) == want


# ------------------------------------------------------------------ 12
URLS = [
    None, "", "no scheme/casino", "http://x.com", "http://", "://", "http://A.Example.NET/EN/", "http://a.example.net/en/x?casino#y", "http://example.net/en", "HTTPS://Example.net?x=/en/", "http://net", "http://net/", "http://xnet/", "http://notexample.com/de/",
    "http://example.com/de/x", "http://u:p@example.com:80/de/", "http://b.org/fr/", "http://b.org/fr", "http://a.b://c/d", "http://free-bets.com/", "http://alphabets.com/free", "http://free.com/free/free", "http://x.com/free%2Dbets", "http://x.com/%66ree/bets",
    "http://casino777.com", "http://casinò.com", "http://éxxx.com", "http://XXX.com", "http://a.com/" + "long/" * 5000 + "porn", "http://example.net/en/porn", "http://a.com/\nspam?", "http://a.org/fr/xxx", "http://İ.com/free",
]


def brute_url(url):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    x = re.sub("%[0-9A-Fa-f]{2}", " ", u).translate(LOWER)
    found = {t for t in urlfilter.VOCABULARY if re.search(f"(?<![a-z\x80-\U0010ffff]){t}(?![a-z\x80-\U0010ffff])", x)}
    score = sum(2 if t in urlfilter.STRICT else 1 for t in found)
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "block" if score >= 2 else "allow"))
    return host, path, rule, verdict, score, " ".join(sorted(found))


def test_urls(spark, tmp_path):
    rows = [(k, u) for k, u in enumerate([*URLS, *URLS[:9]])] + [(None, "http://spam.net")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = urlfilter.query(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "score", "terms").collect()
    assert Counter(map(tuple, got)) == Counter((k, *brute_url(u)) for k, u in rows)
    left = urlfilter.allowed(pages, urlfilter.RULES)
    assert left.columns == pages.columns
    assert Counter(r.page_id for r in left.collect()) == Counter(k for k, u in rows if brute_url(u)[3] == "allow")
    assert urlfilter.judged(pages.where("false"), urlfilter.RULES).count() == 0


def test_url_rules_by_length():
    rules = urlfilter.ordered_rules([("a.com", "/", "block"), ("com", "/xxxxxx/", "allow"), ("a.com", "/x", "allow"), ("A.com", "/x", "allow"), ("b.a.com", "", "block")])
    assert urlfilter.rule_of(rules, "a.com", "/xxxxxx/") == ("com/xxxxxx/", "allow")
    assert urlfilter.rule_of(rules, "b.a.com", "/") == ("b.a.com", "block")
    assert urlfilter.rule_of(rules, "b.a.com", "/x") == ("a.com/x" if len("a.com/x") > len("b.a.com") else "b.a.com", "block")
    assert urlfilter.rule_of(rules, "", "/") is None and urlfilter.rule_of(rules, "d.net", "/") is None
    with pytest.raises(ValueError):
        urlfilter.ordered_rules([("a", "/", "block"), ("a", "/", "allow")])


def test_one_strict_or_two_soft_terms():
    assert not set(urlfilter.STRICT) & set(urlfilter.SOFT)
    find = urlfilter.automaton({"bet": 1, "bets": 1, "be": 2})
    assert urlfilter.terms_in(find, "bets bet-be abet") == {"bets": 1, "bet": 1, "be": 2}
    assert urlfilter.terms_in(find, "alphabets") == {}


# ------------------------------------------------------------------ 13
def brute_phrases(rows, least, longest, within, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in good.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    out = defaultdict(list)
    for (lang, w), a in good.items():
        if inside[lang, w] and 100 * inside[lang, w] >= within * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["the", "The", "of", "new", "york", "times", "é", "ü\u00a0x", "a-b", "日本", "x\0y", "'s"]
    texts = []
    for _ in range(260):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(14))]
        if rng.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = ["new", "York", "times"]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "?!", "\x0b"]) for x in w))
    texts += [None, "", " \t", "...", "word", "aa aa aa aa aa aa aa aa aa aa aa aa", "no space" * 3]
    return [(("en", "de", None, "und")[k % 4 if k % 3 else 0], t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block_bytes,longest,top", [(1 << 23, 3, 2000), (200, 3, 5), (40, 4, 2000), (1000, 2, 3)])
def test_phrases(spark, block_bytes, longest, top):
    rows = phrase_rows()
    docs = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    out = phrases.collocations(docs, min_count=4, max_words=longest, top=top, block_bytes=block_bytes)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == brute_phrases(rows, 4, longest, 50, top)


def test_phrases_of_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b")], docs.schema)).count() == 0


def test_long_texts_are_cut_behind_pieces(spark):
    text = "one two three. " * 400 + "x " * 900 + ", one two three" * 20
    out = phrases.collocations(spark.createDataFrame([("en", text), ("en", text)], "lang string, text string"), block_bytes=64)
    assert sorted(map(tuple, out.collect())) == brute_phrases([("en", text)] * 2, 10, 3, 50, 2000)


def test_counts_beyond_64_bits(spark):
    """Products of counts near 10^13 stay exact."""
    a, l, r = 9_999_999_999_999, 10_000_000_000_019, 9_999_999_999_999
    whole = "decimal(38,0)"
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    got = df.select(F.expr(f"cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as {whole}) * 1000000 as {whole}) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).first()[0]
    assert got == 10**6 * a * a // (l * r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB .\té", max_size=12), min_size=1, max_size=6))
def test_postings_and_merge_joins(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    lang, word, n, at = phrases.postings(pa.array(["q"] * len(texts)), np.frombuffer(b"".join(raw), np.uint8), offsets)
    back_n, back_at = phrases.unpacked(phrases.packed(n, at))
    assert back_n.tolist() == n.tolist() and back_at.tolist() == at.tolist()
    want = Counter(w for t in texts for w in re.findall(r"[^ \t.]+", t.translate(LOWER)))
    assert dict(zip([w.decode() for w in word.to_pylist()], n.tolist())) == want
    first, rest, m, _ = phrases.extended(n, at)
    names = [w.decode() for w in word.to_pylist()]
    pairs = Counter()
    for t in texts:
        for piece in t.translate(LOWER).split("."):
            w = piece.split()
            pairs.update(zip(w, w[1:]))
    assert {(names[i], names[j]): k for i, j, k in zip(first, rest, m.tolist())} == pairs


def peak(f, *args):
    """(result, the most bytes that numpy held meanwhile)"""
    tracemalloc.start()
    out = f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_lists_take_few_bytes_a_word():
    """Two tasks of an executor share its memory with Spark, so a block's arrays must be small."""
    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in rng.zipf(1.2, 400_000) % 50_000).encode()
    offsets = np.linspace(0, len(text), 300).astype(np.int64)
    (_, _, n, at), most = peak(phrases.postings, pa.array(["q"] * 299), np.frombuffer(text, np.uint8), offsets)
    assert most < 48 * len(at)
    blob, most = peak(phrases.packed, n, at)
    assert most < 18 * len(at)
    (n, at), most = peak(phrases.unpacked, pa.py_buffer(blob))
    assert most < 18 * len(at)
    _, most = peak(phrases.extended, n, at)
    assert most < 48 * len(at)


def test_offers_leave_in_small_batches():
    n = np.arange(150_000) % 7 + 1
    out = list(phrases._batch(3, n, first=n + 1, rest=n + 2, blob=b"x"))
    assert max(b.num_rows for b in out) <= 1 << 16
    t = pa.Table.from_batches(out[:-1])
    assert [t.column(c).to_pylist() for c in ("slot", "n", "first", "rest")] == [list(range(150_000)), n.tolist(), (n + 1).tolist(), (n + 2).tolist()]
    assert out[-1].to_pylist() == [{"block": 3, "slot": None, "first": None, "rest": None, "n": None, "lang": None, "word": None, "lists": b"x"}]


def test_large_numbers_of_phrases_stay_exact():
    """Numbers beyond 2^53, of partition 4096 on, are not rounded."""
    block = 5000 << 13 | 3
    ids = [block << 28 | k for k in (1, 3)]
    blob = phrases.packed(np.array([2, 2]), np.array([1, 4, 2, 5]))  # a b. a b
    rows = [{"block": block, "slot": -1, "id": None, "lists": blob}, *({"block": block, "slot": k, "id": ids[k], "lists": None} for k in (0, 1))]
    kinds = pa.schema([("block", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("lists", pa.binary())])
    got = [r for b in phrases._extend(False)(iter([pa.RecordBatch.from_pylist(rows, kinds)])) for r in b.to_pylist()]
    assert [(r["first"], r["rest"], r["n"]) for r in got] == [(ids[0], ids[1], 2)]
