"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards that are never changed. A shard
belongs to the tier ``floor(log_fanout(bytes / smallest))`` of its file's size;
whenever a tier holds ``fanout`` shards they are merged into files of the target
size, and a new manifest version is committed. Readers see exactly the files of
one manifest version, so a merge that dies half-way leaves only unreferenced
files, which ``vacuum`` removes with those of old versions. The manifest names
files below the root, so a table may be moved, and holds the columns of all
arrivals.

A commit creates ``manifest/v<N>.json`` through the Hadoop FileContext: the
text is written to a name of its own and renamed without overwriting. Of two
writers that try the same version one fails and can start again.

Only DataFrame operations touch the rows: batches are cut by a range of the
order key, merges read the files of the merged shards and write them anew
without a shuffle of their own.

Defined cases: null and empty texts are kept, and texts of any length are whole
in one shard (a shard may then pass the target size); rows with a null doc_id
arrive in the first batch; repeated rows stay repeated; shards of equal size and
age are merged in order of their names; an empty arrival adds no shard but still
commits a version; a table without shards has no rows; extra columns are stored as
they are, and rows of arrivals without them hold null there (one name has one
type; ``_shard`` is reserved).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from causeway.llm.common import shared_dir, table

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FANOUT = 4
ARRIVALS = 8
FILE = "(data/[0-9a-f]{32}/[^/]+)$"


@dataclass
class Shard:
    path: str  # below the root
    bytes: int
    rows: int
    born: int
    merged: int = 0


@dataclass
class Manifest:
    version: int = 0
    shards: list[Shard] = field(default_factory=list)
    schema: T.StructType = field(default_factory=T.StructType)


def both(known: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both; all may be null."""
    out = {f.name.lower(): f for f in known}
    for f in new:
        old = out.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
        if old.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {old.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(out.values()))


class ShardedTable:
    """An append-only table of shards at ``root``."""

    def __init__(self, spark: SparkSession, root: str, target=TARGET_BYTES, smallest=SMALLEST_BYTES, fanout=FANOUT):
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target, smallest, fanout
        self._jvm = spark._jvm
        self._fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(root).toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    # ---------------------------------------------------------- manifests
    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        if not self._fc.util().exists(at):
            return []
        names = [f.getPath().getName() for f in self._fc.util().listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if not found:
            return Manifest()
        version = found[-1] if version is None else version
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).collect())
        doc = json.loads(text)
        return Manifest(doc["version"], [Shard(**s) for s in doc["shards"]], T.StructType.fromJson(doc["schema"]))

    def _commit(self, m: Manifest) -> Manifest:
        """Writes version ``m.version + 1``; fails if someone else has."""
        new = Manifest(m.version + 1, m.shards, m.schema)
        text = json.dumps({"version": new.version, "shards": [vars(s) for s in new.shards], "schema": new.schema.jsonValue()}, sort_keys=True)
        hidden, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{new.version:08d}.json")
        fs = hidden.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._fc.rename(hidden, final, options)
        return new

    # -------------------------------------------------------------- writes
    def _write(self, df: DataFrame, born: int, merged: int) -> list[Shard]:
        """The shards of a new folder: sizes from its listing, rows from the footers."""
        at = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", 0).parquet(f"{self.root}/{at}")
        sizes = {f"{at}/{f.getPath().getName()}": f.getLen() for f in self._list(at) if f.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        files = self.spark.read.schema(df.schema).parquet(f"{self.root}/{at}").select(F.regexp_extract(F.input_file_name(), FILE, 1).alias("f"))
        rows = {r.f: r["count"] for r in files.groupBy("f").count().collect()}
        return [Shard(f, n, rows[f], born, merged) for f, n in sorted(sizes.items()) if f in rows]

    def _list(self, at: str) -> list:
        path = self._path(f"{self.root}/{at}")
        return list(self._fc.util().listStatus(path)) if self._fc.util().exists(path) else []

    def append(self, df: DataFrame) -> Manifest:
        """Adds an arrival as small shards, one for each of its partitions."""
        m = self.manifest()
        m.schema = both(m.schema, df.schema)
        m.shards += self._write(df, m.version + 1, 0)
        return self._commit(m)

    def tier(self, s: Shard) -> int:
        t, n = 0, self.smallest
        while s.bytes >= n * self.fanout and n < self.target:
            t, n = t + 1, n * self.fanout
        return t

    def plan(self, m: Manifest) -> list[Shard]:
        """The shards to merge next: the lowest tier, below the target size,
        that holds ``fanout`` shards; empty when none does."""
        tiers: dict[int, list[Shard]] = {}
        for s in m.shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        for _, run in sorted(tiers.items()):
            if len(run) >= self.fanout:
                return sorted(run, key=lambda s: (s.born, s.path))
        return []

    def compact(self) -> Manifest:
        """Merges until no tier is full; every merge is a version."""
        m = self.manifest()
        while run := self.plan(m):
            whole = sum(s.bytes for s in run)
            n = max(1, round(whole / self.target))
            gone = {s.path for s in run}
            new = self._write(self._rows(run, m.schema).coalesce(n), m.version + 1, max(s.merged for s in run) + 1)
            m.shards = [s for s in m.shards if s.path not in gone] + new
            m = self._commit(m)
        return m

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Forgets all versions but the last ``keep`` and removes the files that
        none of these names; returns how many. Files younger than ``older_than``
        seconds stay, since a writer may be about to commit them."""
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        for v in versions[:-keep]:  # first, so that no version lacks a file
            self._fc.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        gone, before = 0, (time.time() - older_than) * 1000
        for folder in self._list("data"):
            at = f"data/{folder.getPath().getName()}"
            for f in self._list(at):
                name = f"{at}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in live and f.getModificationTime() <= before:
                    self._fc.delete(f.getPath(), False)
                    gone += 1
        return gone

    # --------------------------------------------------------------- reads
    def _rows(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version with _shard, the file (below the root) that holds each."""
        m = self.manifest(version)
        if not m.shards:
            return self.spark.createDataFrame([], m.schema).withColumn("_shard", F.lit(""))
        return self._rows(m.shards, m.schema).withColumn("_shard", F.regexp_extract(F.input_file_name(), FILE, 1))


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches by ranges of doc_id, as a stream would have brought them."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    at = [lo + (hi - lo + 1) * i // n for i in range(n)] + [hi + 1]
    within = [(F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in zip(at, at[1:])]
    return [docs.where(within[0] | F.col("doc_id").isNull()), *(docs.where(w) for w in within[1:])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard that holds it after all merges."""
    docs = table(spark, sf_dir, "documents")
    t = ShardedTable(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for batch in arrivals(docs, ARRIVALS):
        t.append(batch)
    m = t.compact()
    t.vacuum(keep=1, older_than=0)  # no one else writes here
    about = spark.createDataFrame([(s.path, s.bytes, s.rows, s.born, s.merged) for s in m.shards], "_shard string, shard_bytes long, shard_rows long, born long, merges long")
    rows = t.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), "_shard")
    part = F.concat_ws("/", F.format_string("v%08d", "born"), F.regexp_extract("_shard", "(part-[0-9]+)", 1))
    return rows.join(about, "_shard").select("doc_id", "n_bytes", "sha256", part.alias("shard"), "shard_bytes", "shard_rows", F.lit(m.version).cast("long").alias("version"), "born", "merges")
