"""A content-addressed store as a log of table folders: artifacts, references, manifests.

Artifacts are rows (key, content, kind, schema, payload, payload_hash), references rows
(manifest, logical_key, key), and a manifest is a row (manifest, repository, ref, commit,
configuration, n, digest), whose digest is the root of a hash tree over its references;
so a manifest without references is one too, and one whose references were harmed shows it.

Version k of the store is a file of its own that names the folders of all tables. It
is renamed into place without overwriting, so of two writers of one version one loses,
looks at what the other has written, and tries again: a write holds its checks against
exactly the version that it follows. A reader that keeps a version's name sees one state
throughout. What a collection rewrites stands in new folders; so do the rows of tables
that have gathered ``MAX_FOLDERS``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causeway.functions.lineage import cut

STORE_SCHEMA_VERSION = "causeway.store/1"
ARTIFACTS = "key string, content string, kind string, schema string, payload string, payload_hash string"
REFS = "manifest string, logical_key string, key string"
MANIFESTS = "manifest string, repository string, ref string, commit string, configuration string, n long, digest string"
TABLES = {"artifacts": ARTIFACTS, "refs": REFS, "manifests": MANIFESTS}
MAX_FOLDERS = 32
LEAF = 256

COLUMNS = ["key", "content", "kind", "schema", "payload", "payload_hash"]
#: from a schema to the next: its name and what rewrites (old, content, kind, payload)
Migrations = dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]


class StoreConflict(ValueError):
    """One key with two contents, or a reference to nothing."""


class StoreCorruption(ValueError):
    """Rows that are not what was written."""


# ------------------------------------------------------------- table operators
def reuse(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(stored, wanted, reused): distinct keys, and how many are there already."""
    a, b = stored.select("key").distinct(), wanted.select("key").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "key", "full")
    return both.agg(F.count("a").alias("stored"), F.count("b").alias("wanted"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("reused"))


def unreferenced(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """(key) of artifacts that no reference reaches."""
    return artifacts.select("key").join(refs.select("key"), "key", "left_anti")


def dangling(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(artifacts.select("key"), "key", "left_anti")


def inventory(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """(artifacts, bytes, unreferenced, manifests, missing_refs)."""
    used, have = refs.select("key", F.lit(1).alias("used")).distinct(), artifacts.select("key", F.lit(1).alias("there"))
    none = F.lit(None)
    a = artifacts.join(used, "key", "left").select(F.octet_length("payload").cast("long").alias("bytes"), F.col("used").isNull().alias("loose"), none.cast("string").alias("manifest"), none.cast("boolean").alias("lost"))
    r = refs.join(have, "key", "left").select(none.cast("long").alias("bytes"), none.cast("boolean").alias("loose"), "manifest", F.col("there").isNull().alias("lost"))
    return a.unionByName(r).agg(
        F.count("loose").alias("artifacts"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if("loose").alias("unreferenced"),
        F.count_distinct("manifest").alias("manifests"), F.count_if("lost").alias("missing_refs"),
    )


def _sound() -> Column:
    """Whether an artifact's address, schema and payload hash fit."""
    fits = (F.sha2("payload", 256) == F.col("payload_hash")) & F.col("key").rlike(r"^artifact-sha256-[0-9a-f]{64}\z") & (F.col("schema") == STORE_SCHEMA_VERSION)
    return F.coalesce(fits, F.lit(False))


def corrupt(artifacts: DataFrame) -> DataFrame:
    """(key) of artifacts whose address or payload hash does not fit."""
    return artifacts.where(~_sound()).select("key")


def merkle(refs: DataFrame) -> DataFrame:
    """(manifest, n, digest): the root of a hash tree over each manifest's references.

    A reference's hash says where it hangs: leaves of about ``LEAF`` references share
    its first hex digits, and sixteen nodes make the one above. So no group is larger, of
    however many references a manifest is, and equal sets give equal roots.
    """
    item = F.sha2(F.to_json(F.struct("logical_key", "key")), 256)
    n = refs.groupBy("manifest").agg(F.count("*").alias("n"))
    deep = cut(n.withColumn("deep", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF) / 4)).cast("int")), "sizes")
    rows = refs.select("manifest", item.alias("hash")).join(deep, "manifest").withColumn("at", F.expr("substring(hash, 1, deep)"))
    whole = lambda: F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("hash"))), 256).alias("hash")
    rows = rows.groupBy("manifest", "n", "deep", "at").agg(whole())
    for d in range(deep.agg(F.max("deep")).first()[0] or 0, 0, -1):
        inner = rows.where(F.length("at") == d).select("manifest", "n", "deep", F.expr(f"substring(at, 1, {d - 1})").alias("at"), F.concat("at", F.lit(":"), "hash").alias("hash"))
        rows = rows.where(F.length("at") < d).unionByName(inner.groupBy("manifest", "n", "deep", "at").agg(whole()))
    return rows.select("manifest", "n", F.col("hash").alias("digest"))


def corrupt_manifests(manifests: DataFrame, refs: DataFrame) -> DataFrame:
    """(manifest) of those whose references are not what they were, or that have some without a row."""
    found = merkle(refs).select("manifest", F.col("n").alias("own_n"), F.col("digest").alias("own_digest"), F.lit(True).alias("there"))
    both = manifests.select("manifest", "n", "digest").join(found, "manifest", "full")
    fits = (F.coalesce("own_n", F.lit(0)) == F.col("n")) & (F.col("own_digest").eqNullSafe(F.col("digest")))
    return both.where(~F.coalesce(fits, F.lit(False))).select("manifest")


def full_inventory(artifacts: DataFrame, refs: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: artifacts, valid_artifacts, corrupt_artifacts, artifact_bytes, unreferenced,
    reclaimable_bytes, manifests, valid_manifests, corrupt_manifests, missing_refs. Only
    valid manifests refer, and only to valid artifacts."""
    bad = corrupt_manifests(manifests, refs)
    held = refs.join(bad, "manifest", "left_anti")
    used = held.select("key", F.lit(True).alias("used")).distinct()
    a = artifacts.select("key", _sound().alias("valid"), F.octet_length("payload").cast("long").alias("size")).join(used, "key", "left")
    loose = F.col("valid") & F.col("used").isNull()
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    a = a.agg(F.count("*").alias("artifacts"), F.count_if("valid").alias("valid_artifacts"), F.count_if(~F.col("valid")).alias("corrupt_artifacts"), sum_("size").alias("artifact_bytes"), F.count_if(loose).alias("unreferenced"), sum_(F.when(loose, F.col("size"))).alias("reclaimable_bytes"))
    m = manifests.select("manifest").join(bad.withColumn("bad", F.lit(True)), "manifest", "full").agg(F.count("*").alias("manifests"), F.count_if(F.col("bad").isNull()).alias("valid_manifests"), F.count("bad").alias("corrupt_manifests"))
    r = held.join(artifacts.where(_sound()).select("key"), "key", "left_anti").agg(F.count("*").alias("missing_refs"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - three single rows side by side
    return one(a).join(one(m), "one").join(one(r), "one").drop("one")


def artifact_key(content: str = "content", kind: str = "kind") -> Column:
    """The address of an artifact's identity."""
    return F.concat(F.lit("artifact-sha256-"), F.sha2(F.to_json(F.struct(F.col(content).alias("content"), F.col(kind).alias("kind"), F.lit(STORE_SCHEMA_VERSION).alias("schema"))), 256))


def find_migration(migrations: Migrations, schema: str) -> list[Callable[[DataFrame], DataFrame]] | None:
    """The steps from ``schema`` to the present one; [] for the present one
    itself, None where no chain leads there."""
    steps, at, seen = [], schema, set()
    while at != STORE_SCHEMA_VERSION:
        if at in seen or at not in migrations:
            return None
        seen.add(at)
        at, step = migrations[at]
        steps.append(step)
    return steps


# ------------------------------------------------------------------- the store
class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.stats = dict.fromkeys((f"{what}_{how}" for what in ("artifact", "manifest") for how in ("hits", "misses", "writes", "reuses")), 0)

    def _files(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        return jvm, jvm.FileContext.getFileContext(jvm.Path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest version: seq, and the folders of each table."""
        jvm, fc = self._files()
        log = jvm.Path(f"{self.root}/log")
        names = [f.getPath().getName() for f in fc.util().listStatus(log)] if fc.util().exists(log) else []
        seqs = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not seqs:
            return {"seq": 0} | {t: [] for t in TABLES}
        return json.loads(self.spark.read.text(f"{self.root}/log/v{max(seqs):010}.json", wholetext=True).first().value)

    def table(self, name: str, at: dict | None = None) -> DataFrame:
        """A table's rows, at a version or now."""
        folders = (at or self.state())[name]
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], TABLES[name])

    @property
    def artifacts(self) -> DataFrame:
        return self.table("artifacts")

    @property
    def refs(self) -> DataFrame:
        """References with what is known of their manifests."""
        at = self.state()
        return self.table("refs", at).join(self.table("manifests", at).drop("n", "digest"), "manifest", "left")

    @property
    def manifests(self) -> DataFrame:
        return self.table("manifests")

    def _written(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], TABLES[name]).columns).write.parquet(f"{self.root}/{folder}")
        return folder

    def _commit(self, new: dict) -> bool:
        """Makes ``new`` the version of its number, unless there is one."""
        jvm, fc = self._files()
        hidden, final = (jvm.Path(f"{self.root}/log/{n}") for n in (f".{uuid.uuid4().hex}", f"v{new['seq']:010}.json"))
        out = hidden.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(hidden)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        rename = jvm.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            fc.rename(hidden, final, options)
        except Exception:
            fc.delete(hidden, False)
            if fc.util().exists(final):
                return False
            raise
        return True

    def _append(self, plan: Callable[[dict], dict[str, DataFrame]]) -> None:
        """Commits the rows that ``plan`` finds to be new at a version, on that version.

        A plan raises where the version conflicts with it. One that has nothing to write
        counts only if the version is still the newest when it has looked.
        """
        while True:
            was = self.state()
            new = dict(was, seq=was["seq"] + 1)
            made = []
            for name, rows in plan(was).items():
                full = len(was[name]) >= MAX_FOLDERS
                made.append(self._written(name, self.table(name, was).unionByName(rows) if full else rows))
                new[name] = [made[-1]] if full else [*was[name], made[-1]]
            if (self._commit(new) if made else self.state()["seq"] == was["seq"]):
                return
            jvm, fc = self._files()
            for folder in made:  # another writer was first
                fc.delete(jvm.Path(f"{self.root}/{folder}"), True)

    def _replace(self, was: dict, **tables: DataFrame) -> None:
        """Commits whole tables on the version they were made from, or fails."""
        new = dict(was, seq=was["seq"] + 1) | {name: [self._written(name, rows)] for name, rows in tables.items()}
        if not self._commit(new):
            raise StoreConflict(f"another writer has made version {new['seq']}")

    def put(self, rows: DataFrame) -> dict[str, int]:
        """Adds artifacts (content, kind, payload): {"written": n, "reused": m}."""
        new = rows.select(artifact_key().alias("key"), "content", "kind", F.lit(STORE_SCHEMA_VERSION).alias("schema"), "payload", F.sha2("payload", 256).alias("payload_hash"))
        new = cut(new.distinct(), "put")
        if bad := new.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").head(1):
            raise StoreConflict(f"{bad[0].key} has two payloads")
        total, written = new.count(), 0

        def plan(was: dict) -> dict[str, DataFrame]:
            nonlocal written
            both = cut(new.join(self.table("artifacts", was).select("key", F.col("payload_hash").alias("had")), "key", "left"), "compared")
            if bad := both.where("had <> payload_hash").head(1):
                raise StoreConflict(f"{bad[0].key} has two payloads")
            fresh = both.where("had is null").drop("had")
            written = fresh.count()
            return {"artifacts": fresh} if written else {}

        self._append(plan)
        self.stats["artifact_writes"] += written
        self.stats["artifact_reuses"] += total - written
        return {"written": written, "reused": total - written}

    def write_manifest(self, manifest: str, refs: DataFrame, repository: str, ref: str, commit: str, configuration: str | None = None) -> bool:
        """Adds a manifest of references (logical_key, key); False if it is there
        already. One name can't stand for two manifests, nor a logical key for two artifacts."""
        refs = cut(refs.select(F.lit(manifest).alias("manifest"), "logical_key", "key").distinct(), "refs")
        if bad := refs.groupBy("logical_key").agg(F.count("*").alias("n")).where("n > 1").head(1):
            raise StoreConflict(f"{bad[0].logical_key} stands for two artifacts")
        root = merkle(refs).first()
        own = (manifest, repository, ref, commit, configuration, root.n if root else 0, root.digest if root else None)
        made = False

        def plan(was: dict) -> dict[str, DataFrame]:
            nonlocal made
            had = self.table("manifests", was).where(F.col("manifest") == manifest).head(1)
            if had and tuple(had[0]) != own:
                raise StoreConflict(f"manifest {manifest} is another")
            if bad := dangling(self.table("artifacts", was), refs).head(1):
                raise StoreConflict(f"no artifact {bad[0].key}")
            made = not had
            return {"refs": refs, "manifests": self.spark.createDataFrame([own], MANIFESTS)} if made else {}

        self._append(plan)
        self.stats["manifest_writes" if made else "manifest_reuses"] += 1
        return made

    # -------------------------------------------------------------- lookups
    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", artifact_key())

    def verified(self, artifacts: DataFrame) -> DataFrame:
        """The artifacts; reading one whose payload doesn't fit its hash fails."""
        fits = (F.sha2("payload", 256) == F.col("payload_hash")) & (~F.col("content").startswith("sha256:") | (F.col("content") == F.concat(F.lit("sha256:"), F.sha2("payload", 256))))
        bad = F.raise_error(F.concat(F.lit("the payload does not fit artifact "), "key"))
        return artifacts.withColumn("payload", F.when(F.coalesce(fits, F.lit(False)), F.col("payload")).otherwise(bad))

    def artifact(self, key: str, verify: bool = False):
        """The artifact's row, or None; with ``verify`` its payload is held against
        its content identity."""
        if not re.fullmatch(r"artifact-sha256-[0-9a-f]{64}", key):
            raise ValueError(f"not an artifact's key: {key}")
        rows = self.artifacts.where(F.col("key") == key)
        row = (self.verified(rows) if verify else rows).first()
        self.stats["artifact_misses" if row is None else "artifact_hits"] += 1
        return row

    def manifest(self, manifest: str) -> DataFrame | None:
        """The references of a manifest, or None; one that was harmed or misses an artifact fails."""
        at = self.state()
        rows = self.table("manifests", at).where(F.col("manifest") == manifest)
        found = bool(rows.head(1))
        self.stats["manifest_hits" if found else "manifest_misses"] += 1
        if not found:
            return None
        refs = self.table("refs", at).where(F.col("manifest") == manifest)
        if corrupt_manifests(rows, refs).head(1):
            raise StoreCorruption(f"manifest {manifest} has not the references it was written with")
        if bad := dangling(self.table("artifacts", at), refs).head(1):
            raise StoreConflict(f"manifest {manifest} misses artifact {bad[0].key}")
        return refs

    def inventory(self) -> DataFrame:
        at = self.state()
        return full_inventory(*(self.table(t, at) for t in TABLES))

    def collect_garbage(self, retain: Column | None = None, dry_run: bool = False, delete_corrupt: bool = False) -> DataFrame:
        """(key) of artifacts that only dropped manifests refer to; ``retain`` is
        a test over the manifests' columns. Unless it is a dry run, they and those
        manifests go. What a corrupt manifest refers to can't be known, so as long as
        one stays no sound artifact goes; with ``delete_corrupt`` it goes, and so do corrupt
        artifacts. A collection that another writer overtakes begins anew."""
        while True:
            was = self.state()
            artifacts, refs, manifests = (self.table(t, was) for t in TABLES)
            bad = cut(corrupt_manifests(manifests, refs), "corrupt")
            protected = not delete_corrupt and bool(bad.head(1))
            sound = manifests.join(bad, "manifest", "left_anti")
            kept = sound if retain is None else sound.where(retain)
            held = refs.join(kept.select("manifest"), "manifest", "left_semi")
            rotten = cut(corrupt(artifacts), "rotten")
            loose = unreferenced(artifacts, held).join(rotten, "key", "left_anti")
            gone = cut((rotten if protected else loose.unionByName(rotten)) if delete_corrupt else loose.where("false") if protected else loose, "gone")
            if dry_run:
                return gone
            if not delete_corrupt:  # what can't be read stays as it is
                kept = kept.unionByName(manifests.join(bad, "manifest", "left_semi"))
                held = held.unionByName(refs.join(bad, "manifest", "left_semi"))
            out = f"{self.root}/removed/{uuid.uuid4().hex}"
            gone.write.parquet(out)
            try:
                self._replace(was, artifacts=artifacts.join(gone, "key", "left_anti"), refs=held, manifests=kept)
            except StoreConflict:
                continue
            return self.spark.read.schema("key string").parquet(out)

    def migrate(self, migrations: Migrations) -> int:
        """Brings artifacts of older schemas to the present one where a chain of
        migrations leads there; references follow their keys, and digests them. The number moved."""
        was = self.state()
        artifacts, refs, manifests = (self.table(t, was) for t in TABLES)
        moved = []
        for schema in sorted(r.schema for r in artifacts.select("schema").distinct().collect()):  # a few versions
            steps = find_migration(migrations, schema)
            if steps:
                new = artifacts.where(F.col("schema") == schema).select(F.col("key").alias("old"), "content", "kind", "payload")
                for step in steps:
                    new = step(new)
                moved.append(new)
        if not moved:
            return 0
        new = cut(reduce(DataFrame.unionByName, moved).select("old", artifact_key().alias("key"), "content", "kind", F.lit(STORE_SCHEMA_VERSION).alias("schema"), "payload", F.sha2("payload", 256).alias("payload_hash")), "migrated")
        rest = artifacts.join(new.select(F.col("old").alias("key")), "key", "left_anti").select(*COLUMNS)
        keys = new.select(F.col("old").alias("key"), F.col("key").alias("new_key"))
        sound = cut(manifests.join(corrupt_manifests(manifests, refs), "manifest", "left_anti").select("manifest"), "sound")
        refs = cut(refs.join(keys, "key", "left").select("manifest", "logical_key", F.coalesce("new_key", "key").alias("key")), "refs")
        anew = merkle(refs.join(sound, "manifest", "left_semi")).select("manifest", F.col("digest").alias("anew"))
        manifests = manifests.join(anew, "manifest", "left").withColumn("digest", F.coalesce("anew", "digest")).drop("anew")
        self._replace(was, artifacts=rest.unionByName(new.select(*COLUMNS)).dropDuplicates(["key"]), refs=refs, manifests=manifests)
        return new.count()

    def recover(self, migrations: Migrations | None = None, corruption: str = "rebuild", incompatible: str = "rebuild") -> dict[str, int]:
        """Migrates what can be, then drops, at once, corrupt artifacts and manifests, those
        of schemas that nothing migrates, and manifests that miss an artifact. With the
        policy ``error`` for either kind of fault, one of it fails and nothing is dropped."""
        if not {corruption, incompatible} <= {"rebuild", "error"}:
            raise ValueError("policies are rebuild and error")
        moved = self.migrate(migrations) if migrations else 0
        was = self.state()
        artifacts, refs, manifests = (self.table(t, was) for t in TABLES)
        other = (F.col("schema") != STORE_SCHEMA_VERSION) & (F.sha2("payload", 256) == F.col("payload_hash"))
        bad = cut(artifacts.where(~_sound()).select("key", F.coalesce(other, F.lit(False)).alias("other")), "corrupt")
        if incompatible == "error" and (one := bad.where("other").head(1)):
            raise StoreCorruption(f"artifact {one[0].key} is of another schema")
        if corruption == "error" and (one := bad.where("not other").head(1)):
            raise StoreCorruption(f"artifact {one[0].key} is corrupt")
        harmed = cut(corrupt_manifests(manifests, refs), "harmed")
        if corruption == "error" and (one := harmed.head(1)):
            raise StoreCorruption(f"manifest {one[0].manifest} is corrupt")
        sound = artifacts.join(bad.select("key"), "key", "left_anti").select(*COLUMNS)
        lost = cut(dangling(sound, refs.join(harmed, "manifest", "left_anti")).select("manifest").distinct(), "lost")
        if corruption == "error" and (one := lost.head(1)):
            raise StoreCorruption(f"manifest {one[0].manifest} misses an artifact")
        n, m, k = bad.count(), harmed.count(), lost.count()
        if n or m or k:
            gone = harmed.unionByName(lost)
            self._replace(was, artifacts=sound, refs=refs.join(gone, "manifest", "left_anti"), manifests=manifests.join(gone, "manifest", "left_anti"))
        return {"artifacts_removed": n, "manifests_removed": m, "manifests_invalidated": k, "migrated": moved}
