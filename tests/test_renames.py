"""Renames of edited files against a plain walk down the sorted pairs."""

import hashlib
import random
import re
import subprocess
from collections import Counter, defaultdict

import pytest

from causeway.operators import renames
from causeway.plans.update import tree_changes
from causeway.sources import git

BLOCK = re.compile(r"[^\n]{0,63}\n|[^\n]{1,64}")


def plain(old, new, threshold=50):
    """{(path, old_path, similarity)} by definition, and the scores of contents left over."""
    sides = []
    for files in (old, new):
        own = defaultdict(list)
        for path, text in sorted(files.items()):
            if text is not None:
                own[hashlib.sha256(text.encode()).hexdigest()].append((path, text))
        sides.append(own)
    a, b = sides
    out = set()
    for c in set(a) & set(b):
        for (p, _), (q, _) in zip(a[c], b[c]):
            out.add((q, p, 100))
        k = min(len(a[c]), len(b[c]))
        a[c], b[c] = a[c][k:], b[c][k:]
    pairs = []
    for x in (c for c in a if a[c]):
        for y in (c for c in b if b[c]):
            s, t = a[x][0][1], b[y][0][1]
            bags = [Counter(m.group() for m in BLOCK.finditer(v)) for v in (s, t)]
            assert sum(len(k) * n for k, n in bags[0].items()) == len(s)
            shared = sum(len(k) * n for k, n in (bags[0] & bags[1]).items())
            if shared and 100 * shared >= threshold * max(len(s), len(t)):
                pairs.append((-(100 * shared // max(len(s), len(t))), x, y))
    for score, x, y in sorted(pairs):
        while a[x] and b[y]:
            out.add((b[y].pop(0)[0], a[x].pop(0)[0], -score))
    return out, {(x, y, -s) for s, x, y in pairs}


def family(rng, n):
    """Texts of shared lines in many mixtures, copies, empty and null ones."""
    lines = ["".join(rng.choice("abcdé𝄞 ") for _ in range(rng.randint(1, 90))) + "\n" for _ in range(12)]
    texts = ["".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return [*texts, *texts[:3], *texts[:2], "", "", None, "\n", "x" * 200, "x" * 260, "one\ntwo"]


def frames(spark, old, new, threshold=50):
    sides = [spark.createDataFrame(list(x.items()), "path string, content string") for x in (old, new)]
    got = {(r.path, r.old_path, r.similarity) for r in renames.similar_renames(*sides, threshold).collect()}
    return got, {(r.o, r.n, r.score) for r in renames.similar_contents(*sides, threshold).collect()}


@pytest.mark.parametrize(("seed", "threshold"), [(1, 50), (2, 80)])
def test_equal_to_a_walk_down_the_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    pool = family(rng, 14)
    old = {f"a/{i}": t for i, t in enumerate(pool)}
    edits = [t if t is None or rng.random() < 0.4 else t + f"more {rng.randrange(3)}\n" if rng.random() < 0.5 else t[: len(t) * 2 // 3] for t in pool + pool[:5]]
    new = {f"b/{i}": t for i, t in enumerate(edits)}
    assert frames(spark, old, new, threshold) == plain(old, new, threshold)


def test_copies_pair_one_by_one_and_empty_sides(spark):
    text = "".join(f"line {i} of a text\n" for i in range(20))
    old = {f"a/{i:02}": text for i in range(30)}
    new = {f"b/{i:02}": text for i in range(8)} | {f"c/{i:02}": text + "more\n" for i in range(15)}
    got, scores = frames(spark, old, new)
    assert (got, scores) == plain(old, new) and len(got) == 23 and len(scores) == 1
    none = spark.createDataFrame([], "path string, content string")
    some = spark.createDataFrame(list(old.items()), "path string, content string")
    assert renames.similar_renames(none, some).count() == renames.similar_renames(some, none).count() == 0


def test_changes_of_a_repository_as_git_tells_them(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: "".join("".join(rng.choice("abcdefgh ") for _ in range(40)) + "\n" for _ in range(n))
    texts = {f"src/{i}.txt": prose(20 + i) for i in range(6)}
    call = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    call("init", "-q")

    def commit(files):
        call("rm", "-rqf", "--ignore-unmatch", ".")
        for name, data in files.items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        call("add", "-A")
        call("commit", "-qm", "c")

    commit(texts | {"bin/a": bytes(range(256)) * 9, "gone.txt": prose(9)})
    moved = {"dst/0.txt": texts["src/0.txt"], "dst/1.txt": texts["src/1.txt"] + prose(3), "dst/2.txt": texts["src/2.txt"][: 41 * 17], "src/3.txt": texts["src/3.txt"] + "x\n"}
    commit(moved | {"src/4.txt": texts["src/4.txt"], "dst/5.txt": prose(25), "bin/b": bytes(range(256)) * 9 + b"tail"})
    got = {(r.kind, r.path, r.old_path, r.similarity) for r in tree_changes(spark, str(tmp_path), "HEAD~1", "HEAD").collect()}
    want = {(r.kind, r.path, r.old_path, r.similarity) for r in git.changed_paths(spark, str(tmp_path), "HEAD~1", "HEAD").collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert sum(x[0] == "renamed" for x in got) == 4
    close = {x[1]: x[3] for x in want}
    assert all(abs(s - close[path]) <= 1 for _, path, _, s in got if s is not None)


def test_rows_of_blocks_are_numbers(spark):
    files = renames._files(spark.createDataFrame([("p", "ab\ncd\nab\n"), ("q", "x")], "path string, content string"))
    bags = renames._bags(files, spark.createDataFrame([(7, "p")], "c long, path string"), 1)
    assert dict(bags.dtypes) == {"side": "int", "c": "bigint", "size": "bigint", "h": "bigint", "w": "bigint"}
    assert sorted((r.side, r.c, r.size, r.w) for r in bags.collect()) == [(1, 7, 9, 3), (1, 7, 9, 6)]
