"""URL filter: a weighted vocabulary of terms, and rules for hosts and paths.

An Aho-Corasick automaton finds every term in the lower-cased URL in one pass. A
find counts where no letter stands before or after it (``bets`` in ``free-bets``,
not in ``alphabets``); digits, punctuation and percent escapes are no letters. Each
term has a weight: a strict one reaches ``REJECT_AT`` alone, soft ones reach it by
several distinct terms. A URL is rejected where the weights of its distinct terms
sum to ``REJECT_AT``.

A rule names a host, a path's beginning and a verdict. It fits the host and all its
subdomains; among the rules that fit, the longest (host and path together, then host)
gives the verdict in place of the vocabulary.

Host and path are column expressions; the automaton is built once in each task from
the terms, which are an argument of the job, as the rules are, and does not grow with
the pages. No shuffle is needed.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no
rule, and is still searched for terms (null: none, so it's allowed); a rule's path
``/`` does not fit an empty path; ports and user names are parts of the host; very
long URLs are read whole; equal rows are judged alike; two rules of one host and
path with different verdicts are refused; an empty table gives an empty result; all
columns are kept, whatever their names, in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from causeway.llm.common import table, wrapped

REJECT_AT = 2
# The vocabulary. A strict term rejects alone.
STRICT = (
    "adult", "bestiality", "blowjob", "bukkake", "camgirl", "camgirls", "camsex", "casino", "casinos", "creampie", "cumshot", "deepfake", "dildo", "ejaculation", "escort", "escorts",
    "fetish", "gangbang", "hardcore", "hentai", "hookup", "incest", "jackpot", "keygen", "malware", "masturbation", "milf", "nsfw", "nude", "nudes", "nudity", "onlyfans", "orgasm", "orgy",
    "phishing", "porn", "porno", "pornography", "pornstar", "roulette", "sexcam", "sexshop", "sexting", "sextoy", "shemale", "slut", "sluts", "spam", "spyware", "striptease", "swingers",
    "threesome", "viagra", "voyeur", "warez", "webcamsex", "xhamster", "xxx", "youporn",
)
# Soft terms reject by two or more distinct ones.
SOFT = (
    "ad", "ads", "affiliate", "babes", "bet", "bets", "betting", "bingo", "bonus", "bookmaker", "cam", "cams", "cash", "cheap", "chat", "clicks", "coupon", "coupons", "crack", "cracked",
    "dating", "deal", "deals", "discount", "download", "earn", "erotic", "farm", "fast", "free", "gambling", "girl", "girls", "hot", "kink", "lingerie", "live", "loan", "loans", "lottery",
    "lotto", "mature", "naked", "odds", "payday", "pharmacy", "pill", "pills", "poker", "popup", "proxy", "replica", "seo", "serial", "sex", "sexy", "singles", "slot", "slots", "spin",
    "teen", "teens", "torrent", "track", "tracker", "tracking", "traffic", "tube", "win", "winner", "winning",
)
VOCABULARY: dict[str, int] = {t: REJECT_AT for t in STRICT} | {t: 1 for t in SOFT}
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)


def automaton(vocabulary: dict[str, int]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        if not term or term != term.lower():
            raise ValueError(f"terms are lower-case and not empty: {term!r}")
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def terms_in(found: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """The distinct terms of a lower-cased text that stand between boundaries, with their weights."""
    out: dict[str, int] = {}
    last = len(text) - 1
    for end, (term, weight) in found.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _letter(text[start - 1])) and (end == last or not _letter(text[end + 1])):
            out[term] = weight
    return out


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or c >= "\x80"


def ordered_rules(rules: tuple[Rule, ...] | list[Rule]) -> dict[str, list[tuple[str, str]]]:
    """(path, verdict) by host, longest paths first."""
    kinds: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block") or kinds.setdefault((host.lower(), path), verdict) != verdict:
            raise ValueError(f"rule {host}{path}: {verdict}")
    out: dict[str, list[tuple[str, str]]] = {}
    for (host, path), verdict in sorted(kinds.items(), key=lambda x: -len(x[0][1])):
        out.setdefault(host, []).append((path, verdict))
    return out


def rule_of(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, as text, and its verdict."""
    best: tuple[tuple[int, int], str, str] | None = None
    at = 0
    while host:
        own = host[at:]
        for start, verdict in rules.get(own, ()):
            if path.startswith(start):
                rank = (len(own) + len(start), len(own))
                if best is None or rank > best[0]:
                    best = rank, own + start, verdict
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best and best[1:]


def judged(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = (), vocabulary: dict[str, int] | None = None, reject_at: int = REJECT_AT) -> DataFrame:
    """(row, host, path, rule, verdict, score, terms): each row of ``pages`` as a
    struct; ``score`` is the weight of its distinct ``terms``."""
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    by_host = ordered_rules(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(vocabulary)
        for b in batches:
            own: list[tuple[str | None, str, int, list[str]]] = []
            for host, path, text in zip(*(b.column(c).to_pylist() for c in ("host", "path", "text"))):
                seen = terms_in(found, text)
                score = sum(seen.values())
                rule = rule_of(by_host, host, path)
                own.append((rule and rule[0], rule[1] if rule else "block" if score >= reject_at else "allow", score, sorted(seen)))
            rule, verdict, score, terms = zip(*own) if own else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                ["row", "host", "path", "rule", "verdict", "score", "terms"],
            )

    url = F.col("row.url")
    host, path = parts(url)
    text = _lower(F.regexp_replace(F.coalesce(url, F.lit("")), "%[0-9A-Fa-f]{2}", " "))
    rows = wrapped(pages).select("row", host.alias("host"), path.alias("path"), text.alias("text"))
    new = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(judge, T.StructType([rows.schema["row"], *new]))


def allowed(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = (), vocabulary: dict[str, int] | None = None, reject_at: int = REJECT_AT) -> DataFrame:
    """``pages`` without the rejected rows, the same columns."""
    out = judged(pages, rules, vocabulary, reject_at).where("verdict = 'allow'")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("row.page_id", "host", "path", "rule", "verdict", "score", F.array_join("terms", " ").alias("terms"))


def _terms_sql(terms: tuple[str, ...], weight: int) -> str:
    return ", ".join(f"('{t}', {weight})" for t in terms)


SQL = f"""
WITH t(term, weight) AS (VALUES {_terms_sql(STRICT, 2)}, {_terms_sql(SOFT, 1)}),
p AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_replace(coalesce(url, ''), '%[0-9A-Fa-f][0-9A-Fa-f]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM p),
u AS (SELECT DISTINCT x FROM q),
s AS (
  SELECT x, sum(weight)::BIGINT AS score, string_agg(term, ' ' ORDER BY term) AS terms
  FROM u JOIN t ON contains(x, term) AND regexp_matches(x, '(^|[^a-z\\x{{80}}-\\x{{10FFFF}}])' || term || '($|[^a-z\\x{{80}}-\\x{{10FFFF}}])')
  GROUP BY x),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(score, 0) >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(score, 0) AS score, coalesce(terms, '') AS terms
FROM r LEFT JOIN s USING (x)
"""
