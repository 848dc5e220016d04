"""The store: commits, conflicts, races, digests, collection, recovery."""

import threading

import pytest
from pyspark.sql import functions as F

from causeway.functions.identity import node_id_of
from causeway.operators import graph as G
from causeway.sources import snapshot, store
from helpers import graph


def rows(spark, *x):
    return spark.createDataFrame([(c, "k", p) for c, p in x], "content string, kind string, payload string")


@pytest.fixture
def s(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/s")


def keys(s):
    return {r.content: r.key for r in s.artifacts.collect()}


def refs(s, *cs):
    known = keys(s)
    return s.spark.createDataFrame([(c, known[c]) for c in cs], "logical_key string, key string")


def test_artifacts(spark, s):
    assert s.put(rows(spark, ("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"))) == {"written": 3, "reused": 0}
    assert s.put(rows(spark, ("a", "1"), ("d", "4"))) == {"written": 1, "reused": 1}
    for clash in ([("a", "other")], [("e", "1"), ("e", "2")]):
        with pytest.raises(store.StoreConflict):
            s.put(rows(spark, *clash))
    assert s.artifacts.count() == 4
    assert s.artifact(keys(s)["b"], verify=True).payload == "2" and s.artifact("artifact-sha256-" + "0" * 64) is None
    with pytest.raises(ValueError):
        s.artifact("x")
    assert s.stats == {"artifact_hits": 1, "artifact_misses": 1, "artifact_writes": 4, "artifact_reuses": 1, "manifest_hits": 0, "manifest_misses": 0, "manifest_writes": 0, "manifest_reuses": 0}


def test_manifests(spark, s):
    s.put(rows(spark, ("a", "1"), ("b", "2"), ("c", "3")))
    assert s.write_manifest("m", refs(s, "a", "b"), "r", "main", "1")
    assert not s.write_manifest("m", refs(s, "b", "a"), "r", "main", "1")  # the same one, in any order
    for other in (refs(s, "a", "c"), refs(s, "a")):
        with pytest.raises(store.StoreConflict, match="is another"):
            s.write_manifest("m", other, "r", "main", "1")
    two = spark.createDataFrame([("x", keys(s)["a"]), ("x", keys(s)["b"])], "logical_key string, key string")
    with pytest.raises(store.StoreConflict, match="two artifacts"):
        s.write_manifest("n", two, "r", "main", "2")
    with pytest.raises(store.StoreConflict, match="no artifact"):
        s.write_manifest("n", spark.createDataFrame([("x", "artifact-sha256-none")], "logical_key string, key string"), "r", "main", "3")
    assert s.write_manifest("none", refs(s, "a").where("false"), "r", "main", "4")
    assert s.manifest("m").count() == 2 and s.manifest("none").count() == 0 and s.manifest("nothing") is None
    assert s.refs.where("manifest = 'm' and commit = '1'").count() == 2
    assert [s.stats[f"manifest_{x}"] for x in ("hits", "misses", "writes", "reuses")] == [2, 1, 2, 1]


def test_empty_and_equal_snapshots(spark, s):
    g = graph(spark, [("file", "f"), ("module", "m")], [("contains", ("module", "m"), ("file", "f"))])
    none = G.Graph(g.nodes.where("false"), g.edges.where("false"), g.diagnostics)
    got, found = snapshot.ensure_snapshot(s, lambda: none, "r", "main", "0")
    assert got.nodes.count() == 0 and not found
    assert snapshot.ensure_snapshot(s, lambda: g, "r", "main", "0")[1]
    assert G.equal(snapshot.ensure_snapshot(s, lambda: g, "r", "main", "1")[0], g)
    assert node_id_of("fixture/graph", "file", "f") in {r.id for r in snapshot.load_snapshot(s, "r", "main", "1").nodes.collect()}


def test_two_writers_of_one_key(spark, s):
    """The second looks again at what the first has committed meanwhile."""
    other = store.Store(spark, s.root)
    commit, raced = s._commit, []

    def late(new):
        if not raced:
            raced.append(other.put(rows(spark, ("a", "1"), ("b", "2"))))
        return commit(new)

    s._commit = late
    assert s.put(rows(spark, ("a", "1"), ("c", "3"))) == {"written": 1, "reused": 1}
    assert raced == [{"written": 2, "reused": 0}] and sorted(r.content for r in s.artifacts.collect()) == ["a", "b", "c"]
    raced.clear()
    with pytest.raises(store.StoreConflict):
        s._commit = lambda new: (raced or raced.append(other.put(rows(spark, ("d", "4"))))) and commit(new)
        s.put(rows(spark, ("d", "other")))
    assert s.artifact(keys(s)["d"]).payload == "4"


def test_a_put_during_a_collection(spark, s):
    """Neither loses the other's rows: the overtaken collection begins anew."""
    s.put(rows(spark, ("a", "1"), ("b", "2")))
    s.write_manifest("m", refs(s, "a"), "r", "main", "1")
    other, commit, raced = store.Store(spark, s.root), s._commit, []

    def late(new):
        if not raced:
            other.put(rows(spark, ("c", "3")))
            other.write_manifest("n", refs(other, "b", "c"), "r", "main", "2")
            raced.append(1)
        return commit(new)

    s._commit = late
    assert s.collect_garbage().count() == 0  # the new manifest refers to b
    assert sorted(keys(s)) == ["a", "b", "c"] and s.manifest("n").count() == 2


def test_a_manifest_of_what_is_collected(spark, s):
    s.put(rows(spark, ("a", "1")))
    want, other, commit, raced = refs(s, "a"), store.Store(spark, s.root), s._commit, []

    def late(new):
        if not raced:
            raced.append(other.collect_garbage().count())
        return commit(new)

    s._commit = late
    with pytest.raises(store.StoreConflict, match="no artifact"):
        s.write_manifest("m", want, "r", "main", "1")
    assert raced == [1] and s.manifest("m") is None


def test_many_writers_at_once(spark, s):
    def write(k):
        own = store.Store(spark, s.root)
        own.put(rows(spark, (f"c{k}", str(k)), ("shared", "x")))
        own.write_manifest(f"m{k}", refs(own, f"c{k}", "shared"), "r", "main", str(k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert s.artifacts.count() == 5 and s.manifests.count() == 4 and s.state()["seq"] == 8
    assert s.inventory().first().missing_refs == 0


def test_folders_are_merged(spark, s, monkeypatch):
    monkeypatch.setattr(store, "MAX_FOLDERS", 3)
    for k in range(5):
        s.put(rows(spark, (f"c{k}", str(k))))
    assert len(s.state()["artifacts"]) == 2 and s.artifacts.count() == 5


def test_hash_trees(spark, monkeypatch):
    monkeypatch.setattr(store, "LEAF", 2)
    one = spark.range(500).select(F.lit("m").alias("manifest"), F.concat(F.lit("k"), "id").alias("logical_key"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    few = one.where("logical_key = 'k7'").withColumn("manifest", F.lit("n"))
    got = {r.manifest: r for r in store.merkle(one.unionByName(few)).collect()}
    assert (got["m"].n, got["n"].n) == (500, 1) and got["n"].digest == store.merkle(few).first().digest
    again = store.merkle(one.repartition(7)).first()
    assert again.digest == got["m"].digest
    for other in (one.where("logical_key <> 'k7'"), one.withColumn("key", F.when(F.col("logical_key") == "k7", "x").otherwise(F.col("key"))), one.withColumn("logical_key", F.when(F.col("logical_key") == "k7", "j7").otherwise(F.col("logical_key")))):
        assert store.merkle(other).first().digest != again.digest


def harm(s, **tables):
    s._replace(s.state(), **tables)


def test_collection(spark, s):
    s.put(rows(spark, ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")))
    s.write_manifest("old", refs(s, "a", "b"), "r", "main", "1")
    s.write_manifest("new", refs(s, "a", "c"), "r", "main", "2")
    k = keys(s)
    retain = F.col("manifest") == "new"
    assert {r.key for r in s.collect_garbage(retain, dry_run=True).collect()} == {k["b"], k["d"]} and s.artifacts.count() == 4
    harm(s, refs=s.table("refs").where("not (manifest = 'new' and logical_key = 'c')"))
    assert s.inventory().first().asDict() | {"artifact_bytes": 0, "reclaimable_bytes": 0} == {
        "artifacts": 4, "valid_artifacts": 4, "corrupt_artifacts": 0, "artifact_bytes": 0, "unreferenced": 2, "reclaimable_bytes": 0, "manifests": 2, "valid_manifests": 1, "corrupt_manifests": 1, "missing_refs": 0,
    }
    assert s.collect_garbage(retain).count() == 0  # a corrupt manifest may refer to anything
    assert {r.manifest for r in s.manifests.collect()} == {"new"}
    assert {r.key for r in s.collect_garbage(retain, delete_corrupt=True).collect()} == set(k.values())
    assert s.artifacts.count() == 0 and s.manifests.count() == 0


def test_recovery(spark, s):
    s.put(rows(spark, ("a", "1"), ("b", "2"), ("c", "3")))
    for name, own in (("one", ("a", "b")), ("two", ("b",)), ("three", ("c",))):
        s.write_manifest(name, refs(s, *own), "r", "main", name)
    nothing = {"artifacts_removed": 0, "manifests_removed": 0, "manifests_invalidated": 0, "migrated": 0}
    assert s.recover(corruption="error", incompatible="error") == nothing
    k = keys(s)
    harm(s, artifacts=s.artifacts.withColumn("payload", F.when(F.col("content") == "a", "x").otherwise(F.col("payload"))), refs=s.table("refs").where("manifest <> 'three'"))
    with pytest.raises(Exception, match="does not fit"):
        s.artifact(k["a"], verify=True)
    with pytest.raises(store.StoreCorruption):
        s.manifest("three")
    with pytest.raises(store.StoreCorruption):
        s.recover(corruption="error")
    assert s.artifacts.count() == 3
    assert s.recover() == nothing | {"artifacts_removed": 1, "manifests_removed": 1, "manifests_invalidated": 1}
    assert {r.manifest for r in s.manifests.collect()} == {"two"} and sorted(keys(s)) == ["b", "c"]
    was = s.state()
    harm(s, refs=s.table("refs"))
    with pytest.raises(store.StoreConflict):
        s._replace(was, refs=s.table("refs"))  # the version exists
    with pytest.raises(ValueError):
        s.recover(corruption="ignore")


def test_migrations(spark, s):
    """A chain leads old artifacts to the present schema; references and digests follow."""
    s.put(rows(spark, ("a", "new"), ("z", "old")))
    s.write_manifest("m", refs(s, "z"), "r", "main", "c")
    old_key = "artifact-sha256-" + "0" * 64
    old = s.artifacts.where("content = 'z'").withColumn("schema", F.lit("old/1")).withColumn("content", F.lit("b")).withColumn("key", F.lit(old_key))
    lost = old.withColumn("schema", F.lit("lost/1")).withColumn("key", F.lit("artifact-sha256-" + "1" * 64))
    moved = s.table("refs").withColumn("key", F.lit(old_key))
    digest = store.merkle(moved).first().digest
    harm(s, artifacts=s.artifacts.where("content = 'a'").unionByName(old).unionByName(lost), refs=moved, manifests=s.manifests.withColumn("digest", F.lit(digest)))
    steps = {"old/1": ("old/2", lambda d: d.withColumn("payload", F.upper("payload"))), "old/2": (store.STORE_SCHEMA_VERSION, lambda d: d.withColumn("kind", F.lit("k2")))}
    assert store.find_migration(steps, "lost/1") is None and store.find_migration(steps | {"lost/1": ("lost/1", None)}, "lost/1") is None
    assert s.recover(steps) == {"artifacts_removed": 1, "manifests_removed": 0, "manifests_invalidated": 0, "migrated": 1}
    assert {(r.content, r.kind, r.payload) for r in s.artifacts.collect()} == {("a", "k", "new"), ("b", "k2", "OLD")}
    assert s.manifest("m").count() == 1
    unknown = s.artifacts.withColumn("schema", F.lit("lost/1"))
    harm(s, artifacts=unknown)
    with pytest.raises(store.StoreCorruption, match="schema"):
        s.recover(incompatible="error")
