"""Extractor plugins: declared facts, accepted or rejected row by row."""

from __future__ import annotations

import contextlib
import json
import subprocess
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from causeway.functions.identity import canonical_json, edge_id, node_id, provenance
from causeway.functions.lineage import cut
from causeway.functions.schema import METHODS
from causeway.operators.graph import EDGE_KEY, NODE_KEY, Graph, build, facts_of, violation

PLUGIN_VERSION = "causeway.plugin/1"


@dataclass(frozen=True)
class Descriptor:
    """What a plugin may emit; empty kind lists allow every kind."""

    name: str
    version: str
    schema: str
    methods: tuple[str, ...]
    states: tuple[str, ...]
    node_kinds: tuple[str, ...] = ()
    edge_kinds: tuple[str, ...] = ()

    def __post_init__(self):
        if not all((self.name, self.version, self.schema)):
            raise ValueError("name, version and schema must not be empty")
        if not self.methods or "explicit-overlay" in self.methods or set(self.methods) - set(METHODS):
            raise ValueError("a plugin names its evidence methods, overlays excluded")
        if not self.states:
            raise ValueError("a plugin names its states")
        for f in ("methods", "states", "node_kinds", "edge_kinds"):
            object.__setattr__(self, f, tuple(sorted(set(getattr(self, f)))))

    @property
    def key(self) -> str:
        return "\0".join((self.name, self.version, self.schema))

    def to_json(self) -> str:
        return canonical_json({"protocol": PLUGIN_VERSION, **{k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items()}})


@dataclass(frozen=True)
class Plugin:
    descriptor: Descriptor
    #: (spark, request) -> (node facts, edge facts)
    extract: Callable[[SparkSession, dict], tuple[DataFrame, DataFrame]] = field(compare=False)


def admissible(provenance: Column, d: Descriptor, repository: str, ref: str) -> Column:
    """All records must be of the request and of the plugin's declaration."""

    def ok(p: Column) -> Column:
        mine = (p.extractor["name"] == d.name) & (p.extractor["version"] == d.version)
        return F.coalesce(mine & (p.repository == repository) & (p.ref == ref) & p.method.isin(*d.methods) & p.state.isin(*d.states) & (p.origin != "overlay"), F.lit(False))

    return (F.size(provenance) > 0) & F.forall(provenance, ok)


def accept(base: DataFrame, offered: DataFrame, valid: Column, what: str) -> tuple[DataFrame, DataFrame]:
    """(accepted facts, (code, id) of the rejected).

    ``base`` has id and metadata; ``offered`` has id, metadata, provenance, ``plugin``
    (the descriptor's key) and ``fact`` (its number). The first valid fact of an id
    sets the metadata - the base before any plugin, plugins by key - and later
    ones with other metadata are conflicts.
    """
    tagged = offered.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_m", F.coalesce("metadata", F.lit("<absent>")))
    base = base.select("id", F.coalesce("metadata", F.lit("<absent>")).alias("_base"))
    order = W.partitionBy("id").orderBy(F.col("_valid").desc(), "plugin", "fact")
    tagged = tagged.join(base, "id", "left").withColumn("_first", F.coalesce("_base", F.first("_m").over(order)))
    code = F.when(~F.col("_valid"), f"extractor-invalid-{what}").when(F.col("_m") != F.col("_first"), f"extractor-{what}-conflict")
    tagged = tagged.withColumn("code", code)
    return tagged.where("code is null").select(*offered.columns), tagged.where("code is not null").select("code", "id", "plugin")


def _feed(into: IO[bytes], data: bytes) -> None:
    with contextlib.suppress(OSError):  # it may not read all that it is told
        into.write(data)
        into.close()


def external(command: list[str], d: Descriptor, timeout: float = 30.0, most_bytes: int = 16 << 20) -> Callable[[dict], dict]:
    """A plugin in a process of its own: one canonical JSON line in, one JSON
    document out, whose descriptor must equal the declared one. It is ended at
    ``timeout`` seconds, and as soon as it has written more than ``most_bytes``."""

    def run(request: dict) -> dict:
        asked = (canonical_json({"protocol": PLUGIN_VERSION, "request": request}) + "\n").encode()
        got, late = bytearray(), threading.Event()
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:
            timer = threading.Timer(timeout, lambda: (late.set(), process.kill()))
            timer.start()
            feeder = threading.Thread(target=_feed, args=(process.stdin, asked))
            feeder.start()
            try:
                while piece := process.stdout.read1(1 << 16):
                    got += piece
                    if len(got) > most_bytes:
                        raise ValueError("the plugin's answer is too long")
                code = process.wait()
            finally:
                process.kill()
                timer.cancel()
                feeder.join()
        if late.is_set():
            raise TimeoutError(f"the plugin took more than {timeout} seconds")
        if code:
            raise RuntimeError(f"the plugin ended with {code}")
        answer = json.loads(bytes(got))
        if not isinstance(answer, dict) or not isinstance(answer.get("output"), dict) or canonical_json(answer.get("descriptor")) != d.to_json():
            raise ValueError("the plugin's answer does not fit its declaration")
        return answer["output"]

    return run


def run_plugins(base: Graph, plugins: list[Plugin], request: dict) -> Graph:
    """The base graph with the facts of all plugins, in the order of their keys.

    Each plugin is asked with the base graph, not with what others gave. A plugin
    that raises, when asked or when its rows are made, gives a diagnostic and
    nothing else; rejected facts give one each. ``request`` has repository and ref.
    """
    spark, repository, ref = base.nodes.sparkSession, request["repository"], request["ref"]
    failed, nodes, edges = [], [], []
    for plugin in sorted(plugins, key=lambda p: p.descriptor.key):
        d = plugin.descriptor
        try:
            got = [cut(facts, "offered") for facts in plugin.extract(spark, request | {"graph": base})]
        except Exception as error:
            failed.append((d, str(error).splitlines()[0] if str(error) else type(error).__name__))
            continue
        for facts, into, kinds, key in ((got[0], nodes, d.node_kinds, NODE_KEY), (got[1], edges, d.edge_kinds, EDGE_KEY)):
            identity = node_id(*NODE_KEY) if into is nodes else edge_id(*EDGE_KEY)
            sound = F.forall("provenance", lambda p: violation(p).isNull())
            for k in key:
                sound = sound & (F.coalesce(F.col(k) != "", F.lit(k == "edge_key")))
            kind = F.col("kind").isin(*kinds) if kinds else F.lit(True)
            into.append(facts.select("*", identity.alias("id"), F.lit(d.key).alias("plugin"), F.monotonically_increasing_id().alias("fact"), (admissible(F.col("provenance"), d, repository, ref) & kind & sound).alias("valid")))
    empty = {id(nodes): base.nodes, id(edges): base.edges}
    offered = [reduce(DataFrame.unionByName, x) if x else empty[id(x)].where("false").select("*", F.lit("").alias("plugin"), F.lit(0).cast("long").alias("fact"), F.lit(False).alias("valid")) for x in (nodes, edges)]
    good_nodes, bad_nodes = accept(base.nodes, offered[0], F.col("valid"), "node")
    known = base.nodes.select("id").unionByName(good_nodes.select("id")).distinct()
    ends = [known.select(F.col("id").alias(e), F.lit(True).alias(f"has_{e}")) for e in ("src", "dst")]
    there = offered[1].join(ends[0], "src", "left").join(ends[1], "dst", "left").withColumn("valid", F.col("valid") & F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()).drop("has_src", "has_dst")
    good_edges, bad_edges = accept(base.edges, there, F.col("valid"), "edge")

    def told(name: Column, version: Column, code: Column, message: Column) -> list[Column]:
        named = F.struct(name.alias("name"), version.alias("version"))
        proof = provenance(repository=repository, ref=ref, commit=request.get("commit"), extractor=named, origin="derived", method="deterministic-extraction", state="unresolved", diagnostic=message)
        return [code.alias("code"), message.alias("message"), F.lit("unresolved").alias("state"), proof.alias("provenance")]

    part = F.split("plugin", "\u0000")
    rejected = bad_nodes.unionByName(bad_edges)
    rejected = rejected.select(*told(part[0], part[1], F.col("code"), F.concat(part[0], F.lit("@"), part[1], F.lit(" offered a fact that is not accepted: "), "id")))
    lost = spark.createDataFrame([(d.name, d.version, m) for d, m in failed], "name string, version string, why string")
    lost = lost.select(*told(F.col("name"), F.col("version"), F.lit("extractor-failed"), F.concat("name", F.lit("@"), "version", F.lit(" failed: "), "why")))
    base_nodes, base_edges = facts_of(base)
    return build(base_nodes.unionByName(good_nodes.select(*base_nodes.columns)), base_edges.unionByName(good_edges.select(*base_edges.columns)), base.diagnostics.unionByName(rejected).unionByName(lost), check=False)
