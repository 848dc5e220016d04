"""Several repositories' graphs joined through package coordinates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from causeway.functions.identity import coordinate_key, node_id, provenance
from causeway.functions.lineage import cut
from causeway.operators.graph import Graph, build, facts_of
from causeway.operators.traverse import MAX_DEPTH

COORDINATES = "causeway:coordinates"  # the namespace of coordinate nodes


def outcomes(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """One outcome per mapping, by joins.

    ``mappings``: id, c_repository, c_kind, c_key, kind, ecosystem, name, version,
    and p_repository, p_kind, p_key, null without an explicit producer. ``nodes``:
    repository, id, kind, key, ecosystem, name, version. Adds consumer, producer,
    coordinate (node ids) and outcome: connected, or the code of the diagnostic.
    """
    at = nodes.select("repository", "kind", "key", "id")
    consumer = at.select(F.col("repository").alias("c_repository"), F.col("kind").alias("c_kind"), F.col("key").alias("c_key"), F.col("id").alias("consumer"))
    explicit = nodes.select(F.col("repository").alias("p_repository"), F.col("kind").alias("p_kind"), F.col("key").alias("p_key"), F.col("id").alias("named"), F.coalesce((F.col("kind") == "package"), F.lit(False)).alias("is_package"), F.col("ecosystem").alias("e_ecosystem"), F.col("name").alias("e_name"), F.col("version").alias("e_version"))
    inferred = nodes.where("kind = 'package'").groupBy("ecosystem", "name", "version").agg(F.count("*").alias("matches"), F.min("id").alias("guess"))
    out = mappings.join(consumer, ["c_repository", "c_kind", "c_key"], "left").join(explicit, ["p_repository", "p_kind", "p_key"], "left").join(inferred, ["ecosystem", "name", "version"], "left")
    matches = F.when(F.col("kind") == "package", F.coalesce("matches", F.lit(0))).otherwise(0)
    fits = F.coalesce(F.col("is_package") & (F.col("e_ecosystem") == F.col("ecosystem")) & (F.col("e_name") == F.col("name")) & (F.col("e_version") == F.col("version")), F.lit(False))
    stated = F.col("p_repository").isNotNull()
    outcome = (
        F.when(F.col("consumer").isNull(), "cross-repo-consumer-unresolved")
        .when(stated & F.col("named").isNull(), "cross-repo-producer-unresolved")
        .when(stated & (F.col("kind") == "package") & ~fits, "cross-repo-producer-coordinate-mismatch")
        .when(~stated & (matches == 0), "cross-repo-producer-unresolved")
        .when(~stated & (matches > 1), "cross-repo-producer-ambiguous")
        .otherwise("connected")
    )
    coordinate = node_id(F.lit(COORDINATES), F.lit("coordinate"), coordinate_key(F.col("kind"), F.col("ecosystem"), F.col("name"), F.col("version")))
    out = out.withColumn("outcome", outcome).withColumn("producer", F.when(F.col("outcome") == "connected", F.coalesce("named", "guess")))
    return out.select(*mappings.columns, "consumer", "producer", coordinate.alias("coordinate"), "outcome")


def metrics(found: DataFrame) -> DataFrame:
    """(mappings, connected, unresolved, ambiguous)."""
    return found.agg(F.count("*").alias("mappings"), F.count_if(F.col("outcome") == "connected").alias("connected"), F.count_if(~F.col("outcome").isin("connected", "cross-repo-producer-ambiguous")).alias("unresolved"), F.count_if(F.col("outcome") == "cross-repo-producer-ambiguous").alias("ambiguous"))


def bridges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(at, to, cost): from a producer to each consumer of its coordinates; a hop
    costs 1 where the repositories differ."""
    spaces = nodes.select("id", "repository")
    ok = found.where("outcome = 'connected'").select("producer", "consumer", "coordinate").distinct()
    a, b = (spaces.withColumnsRenamed({"id": x, "repository": f"{x}_at"}) for x in ("producer", "consumer"))
    return ok.join(a, "producer").join(b, "consumer").select(F.col("producer").alias("at"), F.col("consumer").alias("to"), "coordinate", (F.col("producer_at") != F.col("consumer_at")).cast("int").alias("cost"))


def affected_across(steps: DataFrame, starts: DataFrame, max_hops: int = 1, max_rounds: int = MAX_DEPTH) -> tuple[DataFrame, bool]:
    """((id, hops), truncated) of consumers reached within the hop budget.

    Relaxation by rounds to the least hops of each node; the start is a result
    only if a cycle leads back to it. ``truncated``: some step from a node in the
    result leaves the budget.
    """
    steps = cut(steps.groupBy("at", "to").agg(F.min("cost").alias("cost")), "bridges")
    begin = starts.select("id").distinct().withColumn("hops", F.lit(0))
    best = steps.sparkSession.createDataFrame([], "id string, hops int")
    frontier, truncated = cut(begin, "hops"), False
    for _ in range(max_rounds):
        near = frontier.join(steps.withColumnRenamed("at", "id"), "id").select(F.col("to").alias("id"), (F.col("hops") + F.col("cost")).alias("hops"))
        truncated = truncated or bool(near.where(F.col("hops") > max_hops).head(1))
        near = near.where(F.col("hops") <= max_hops).groupBy("id").agg(F.min("hops").alias("hops"))
        was = best.withColumnRenamed("hops", "was")
        frontier = cut(near.join(was, "id", "left").where("was is null or hops < was").select("id", "hops"), "hops")
        if not frontier.head(1):
            break
        best = cut(best.unionByName(frontier).groupBy("id").agg(F.min("hops").alias("hops")), "hops")
    return best, truncated


@dataclass(frozen=True)
class Across:
    """``nodes`` and ``edges`` (id) of the slice; ``truncated``: a bound left something out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def affected_within(g: Graph, start: str, max_hops: int = 1, max_nodes: int = 100) -> Across:
    """Consumers of ``start`` and of theirs, with the coordinates between, within both bounds.

    What a queue does that takes packages in turn, and of each the links (coordinate,
    consumer) by the ids of their edges: a link beyond ``max_hops`` is left out, so is
    one whose coordinate and consumer together don't fit into ``max_nodes`` any more,
    while a later one that brings less may fit; a consumer is taken again when it is
    reached with fewer hops. A round is one whole generation of the queue, in order. The
    bound can only bind once: all links before it are admitted, with one place left the
    first link that brings one node, then only links between nodes of the slice.
    """
    if max_hops < 0 or max_nodes < 1:
        raise ValueError("bounds must not be negative")
    spark = g.nodes.sparkSession
    nodes = g.nodes.select("id", "namespace")
    if not nodes.where(F.col("id") == start).head(1):
        raise ValueError(f"no node {start}")
    resolve = g.edges.where("kind = 'coordinate-resolves-to'").select(F.col("id").alias("resolve_edge"), F.col("src").alias("coordinate"), F.col("dst").alias("at"))
    depend = g.edges.where("kind = 'depends-on-coordinate'").select(F.col("id").alias("depend_edge"), F.col("src").alias("consumer"), F.col("dst").alias("coordinate"))
    links = resolve.join(nodes.select(F.col("id").alias("coordinate")), "coordinate", "left_semi").join(depend, "coordinate")
    for c in ("consumer", "at"):
        links = links.join(nodes.select(F.col("id").alias(c), F.col("namespace").alias(f"{c}_space")), c)
    links = cut(links.select("at", "resolve_edge", "coordinate", "depend_edge", "consumer", (F.col("consumer_space") != F.col("at_space")).cast("int").alias("cost")), "links")
    frontier = spark.createDataFrame([(start, 0, 0)], "at string, hops int, pos long")
    labels = spark.createDataFrame([(start, 0)], "consumer string, was int")
    chosen, edges, truncated, used = spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string"), False, 0
    while True:
        near = frontier.join(links, "at").select(F.struct("pos", "resolve_edge", "depend_edge").alias("turn"), "coordinate", "consumer", (F.col("hops") + F.col("cost")).alias("hops"))
        near = cut(near, "near")
        truncated = truncated or bool(near.where(F.col("hops") > max_hops).head(1))
        near = near.where(F.col("hops") <= max_hops)
        first = near.select(F.explode(F.array("coordinate", "consumer")).alias("id"), "turn").groupBy("id").agg(F.min("turn").alias("turn"))
        first = cut(first.join(chosen, "id", "left_anti"), "first")
        left, admitted = max_nodes - used, near
        if first.count() <= left:
            chosen = cut(chosen.unionByName(first.select("id")), "chosen")
        else:
            truncated = True
            at = first.orderBy("turn", "id").limit(left + 1).agg(F.max("turn").alias("t")).first().t
            bound = F.struct(*[F.lit(x) for x in at]).cast(near.schema["turn"].dataType)  # the first link that does not fit
            chosen = cut(chosen.unionByName(first.where(F.col("turn") < bound).select("id")), "chosen")
            if chosen.count() < max_nodes:
                there = [chosen.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("coordinate", "consumer")]
                later = near.where(F.col("turn") >= bound).join(there[0], "coordinate", "left").join(there[1], "consumer", "left")
                later = later.where(F.col("has_coordinate").isNull() != F.col("has_consumer").isNull())
                one = later.agg(F.min_by(F.when(F.col("has_consumer"), F.col("coordinate")).otherwise(F.col("consumer")), "turn").alias("id")).where("id is not null")
                chosen = cut(chosen.unionByName(one), "chosen")
            for c in ("coordinate", "consumer"):
                admitted = admitted.join(chosen.select(F.col("id").alias(c)), c, "left_semi")
            admitted = cut(admitted, "admitted")
        used = chosen.count()
        edges = cut(edges.unionByName(admitted.select(F.explode(F.array("turn.resolve_edge", "turn.depend_edge")).alias("id"))).distinct(), "edges")
        earlier = F.min("turn").over(W.partitionBy("consumer").orderBy("hops").rowsBetween(W.unboundedPreceding, -1))  # a row for each number of hops
        better = admitted.groupBy("consumer", "hops").agg(F.min("turn").alias("turn")).withColumn("earlier", earlier).join(labels, "consumer", "left")
        better = better.where((F.col("was").isNull() | (F.col("hops") < F.col("was"))) & (F.col("earlier").isNull() | (F.col("earlier") > F.col("turn"))))
        frontier = cut(better.repartitionByRange("turn").sortWithinPartitions("turn").select(F.col("consumer").alias("at"), "hops", F.monotonically_increasing_id().alias("pos")), "frontier")
        if not frontier.head(1):
            return Across(chosen, edges, truncated)
        labels = cut(labels.unionByName(frontier.select(F.col("at").alias("consumer"), F.col("hops").alias("was"))).groupBy("consumer").agg(F.min("was").alias("was")), "labels")


def one_of_each(snapshots: DataFrame) -> None:
    """Fails where a repository has two snapshots, or one without its names."""
    bad = snapshots.groupBy("repository").agg(F.count("*").alias("n"), F.count_if(F.least(*[F.length(F.coalesce(c, F.lit(""))) for c in ("repository", "ref", "commit")]) == 0).alias("blank")).where("n > 1 or blank > 0").head(1)
    if bad:
        raise ValueError(f"duplicate snapshot of repository {bad[0].repository!r}" if bad[0].n > 1 else "a snapshot needs a repository, a ref and a commit")


def composed_facts(found: DataFrame, nodes: DataFrame, snapshots: DataFrame, name: str, version: str, authority: str = "authoritative") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node facts, edge facts, diagnostics) that the mappings of ``found`` (see
    ``outcomes``) add to the union of the repositories' graphs.

    ``snapshots`` has one row (repository, ref, commit) for each repository. A
    connected mapping gives its coordinate as a node, an edge from the consumer to
    it and one from it to the producer, each with evidence pinned to the snapshot
    it speaks of; any other gives a diagnostic at its consumer, or at the first
    repository where the consumer's is unknown.
    """

    def proof(side: str, path: Column | str, state: Column | str = "complete", message: Column | None = None) -> Column:
        at = {c: F.col(f"{side}_{c}") for c in ("repository", "ref", "commit")}
        named = F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"))
        return provenance(**at, path=F.col(path) if isinstance(path, str) else path, origin="overlay", method="explicit-overlay", state=state, authority=authority, overlay=named, diagnostic=message)

    def pinned(side: str) -> DataFrame:
        return snapshots.select(*(F.col(c).alias(f"{side}_{c}") for c in ("repository", "ref", "commit")))

    first = snapshots.agg(F.min_by(F.struct("repository", "ref", "commit"), "repository").alias("first"))
    about = found.drop("p_repository", "p_kind", "p_key").join(pinned("c"), "c_repository", "left").join(F.broadcast(first))  # one row
    about = about.select(*[c for c in about.columns if c not in ("c_repository", "c_ref", "c_commit", "first")], *(F.when(F.col("c_ref").isNotNull(), F.col(f"c_{c}")).otherwise(F.col(f"first.{c}")).alias(f"c_{c}") for c in ("repository", "ref", "commit")))
    ok = about.where("outcome = 'connected'").join(nodes.select(F.col("id").alias("producer"), F.col("repository").alias("p_repository"), F.col("key").alias("p_key")), "producer").join(pinned("p"), "p_repository")
    ok = ok.withColumn("text", coordinate_key(F.col("kind"), F.col("ecosystem"), F.col("name"), F.col("version")))
    node_facts = ok.select(F.lit(COORDINATES).alias("namespace"), F.lit("coordinate").alias("kind"), F.col("text").alias("key"), F.col("text").alias("metadata"), F.array(proof("c", "c_key"), proof("p", "p_key")).alias("provenance"))
    wanted = F.concat(F.lit('{"coordinate":'), "text", F.lit(","), F.expr("substr(to_json(named_struct('mappingId', id)), 2)"))
    kept = F.to_json(F.struct(F.col("p_commit").alias("producerCommit"), F.col("p_ref").alias("producerRef"), F.col("p_repository").alias("producerRepository")))
    depends = ok.select(F.lit("depends-on-coordinate").alias("kind"), F.col("consumer").alias("src"), F.col("coordinate").alias("dst"), F.col("id").alias("edge_key"), wanted.alias("metadata"), F.array(proof("c", "c_key")).alias("provenance"))
    resolves = ok.select(F.lit("coordinate-resolves-to").alias("kind"), F.col("coordinate").alias("src"), F.col("producer").alias("dst"), F.col("text").alias("edge_key"), kept.alias("metadata"), F.array(proof("p", "p_key")).alias("provenance"))
    state = F.when(F.col("outcome") == "cross-repo-producer-ambiguous", "partial").otherwise("unresolved")
    message = F.concat_ws(" ", F.lit("mapping"), "id", F.lit("of"), F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version"), F.lit("is not connected:"), "outcome")
    lost = about.where("outcome <> 'connected'").select(F.col("outcome").alias("code"), message.alias("message"), state.alias("state"), proof("c", "c_key", state, message).alias("provenance"))
    return node_facts, depends.unionByName(resolves), lost


def compose(graphs: list[Graph], found: DataFrame, nodes: DataFrame, snapshots: DataFrame, name: str, version: str, authority: str = "authoritative", check: bool = True) -> Graph:
    """The graphs of several repositories as one, with their mappings."""
    one_of_each(snapshots)
    parts = [facts_of(g) for g in graphs]
    more_nodes, more_edges, lost = composed_facts(found, nodes, snapshots, name, version, authority)
    stack = lambda frames: reduce(DataFrame.unionByName, frames)
    return build(stack([*(p[0] for p in parts), more_nodes]), stack([*(p[1] for p in parts), more_edges]), stack([*(g.diagnostics for g in graphs), lost]), check=check)
