"""Packing token sequences: first-fit decreasing in randomised groups.

Documents become token ids (byte-level BPE) and a separator. Whole runs of
``LENGTH`` ids are sequences by themselves; what remains of each document goes,
with its ids, to a group drawn by hash. Inside a group the remainders, largest
first, go to the first bin with room, found in a tournament tree of bin
capacities. Then the emptiest bins are cut up to fill the gaps of the fullest,
and the last open bin is cut into sequences whose lengths are powers of two,
which need no padding. Groups have about ``GROUP_DOCS`` documents at every input
size, so they pack independently and memory is bounded.

Only remainders (below ``LENGTH`` ids, two bytes each) are shuffled; checksums
of the whole runs are taken where the text is tokenized.

Defined cases: a null or empty text has only the separator; repeated rows are
packed each by itself and dealt over the groups; ties of size are in the order of
the draw; texts of any length are cut into whole runs; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm.common import bounds, runs, table

LENGTH = 1024
GROUP_DOCS = 1024
SEPARATOR = 0
LONG = 1_000_000
#: How byte-level BPE splits a text into pieces (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids, as the ``tokenizers`` library gives them for a file, as
    little-endian 16-bit bytes.

    For byte-level BPE whose ids are the merges' ranks, the same merges are run
    by tiktoken, which takes a quarter of the time and gives equal ids (the tests
    compare both on random Unicode). Other files, texts that may hold one of the
    file's added tokens, and texts beyond ``LONG`` characters, whose white space
    could exhaust its pattern matcher, are left to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than two bytes")
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        ranks = byte_ranks(path)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or len(text) > LONG or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The file's vocabulary as bytes, if it is plain byte-level BPE in rank order."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    model, split = doc["model"], doc.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and doc.get("normalizer") is None
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    # byte-level files write printable bytes as themselves and the others from U+0100 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    vocab = model["vocab"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)) or any(c not in byte for t in vocab for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tokens, crcs, rest = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = enc(text or "") + np.array([SEPARATOR], "<u2").tobytes()
                    n = len(ids) // 2
                    full = n // length
                    wide = np.frombuffer(ids, "<u2", full * length).astype("<u4").tobytes()
                    tokens.append(n)
                    crcs.append([zlib.crc32(wide[4 * length * k : 4 * length * (k + 1)]) for k in range(full)])
                    rest.append(ids[2 * full * length :])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], ["doc_id", "draw", "tokens", "crcs", "rest"])

    return scan


# ------------------------------------------------------------ one group
class Bins:
    """Bins of equal capacity under a tournament tree of what is left."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.left = np.full(2 * self.leaves, capacity).tolist()

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which it takes."""
        tree, i = self.left, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        at, i = i - self.leaves, i // 2
        while i:
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
            i //= 2
        return at


def pack(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items in decreasing size.

    First-fit decreasing, then gaps are filled from the emptiest bins, then
    the last open bin is cut at powers of two.
    """
    bins: list[list[tuple[int, int, int]]] = []
    tree = Bins(len(sizes), length)
    for item, size in enumerate(sizes):
        at = tree.put(size)
        while at >= len(bins):
            bins.append([])
        bins[at].append((item, 0, size))
    gap = [length - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (gap[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, out = order[lo], order[hi]
        if not gap[to]:
            lo += 1
        elif not bins[out]:
            hi -= 1
        else:
            item, start, size = bins[out].pop()
            take = min(size, gap[to])
            bins[to].append((item, start + size - take, take))
            gap[to] -= take
            gap[out] += take
            if take < size:
                bins[out].append((item, start, size - take))
    done: list[list[tuple[int, int, int]]] = []
    for i in sorted(order):
        queue = bins[i][::-1]
        used = length - gap[i]
        while used:
            room = size_left = 1 << (used.bit_length() - 1)
            seq: list[tuple[int, int, int]] = []
            while size_left:
                item, start, size = queue.pop()
                take = min(size, size_left)
                seq.append((item, start, take))
                size_left -= take
                if take < size:
                    queue.append((item, start + take, size - take))
            done.append(seq)
            used -= room
    return done


def _pack_groups(length: int):
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["part"]):
            part, draw, tokens = (t.column(c).to_numpy() for c in ("part", "draw", "tokens"))
            ids, crcs, rest = (t.column(c).to_pylist() for c in ("doc_id", "crcs", "rest"))
            cut_at = bounds(t, ["part"])
            for a, b in zip(cut_at, cut_at[1:]):
                rows: list[tuple] = []
                seq = int(part[a]) << 32
                order = sorted(range(a, b), key=lambda i: (-len(rest[i]), draw[i], ids[i] is None, ids[i] or 0, tokens[i]))
                for i in order:
                    for k, c in enumerate(crcs[i]):
                        rows.append((ids[i], k * length, length, c, tokens[i], seq, 0))
                        seq += 1
                items = [i for i in order if rest[i]]
                for pieces in pack([len(rest[i]) // 2 for i in items], length):
                    at = 0
                    for item, start, size in pieces:
                        i = items[item]
                        wide = np.frombuffer(rest[i], "<u2", size, 2 * start).astype("<u4").tobytes()
                        rows.append((ids[i], len(crcs[i]) * length + start, size, zlib.crc32(wide), tokens[i], seq, at))
                        at += size
                    seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], fields)

    return scan


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # the running number deals equal rows over the groups
    n_parts = max(1, -(-docs.count() // group_docs))
    drawn = docs.select("doc_id", "text", F.xxhash64(F.lit(11), "doc_id", "text", F.monotonically_increasing_id()).alias("draw"))
    tokens = drawn.mapInArrow(_tokenize(tokenizer or default_tokenizer(), length), "doc_id long, draw long, tokens long, crcs array<long>, rest binary")
    grouped = tokens.withColumn("part", F.pmod("draw", F.lit(n_parts))).repartition("part").sortWithinPartitions("part")
    return grouped.mapInArrow(_pack_groups(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
