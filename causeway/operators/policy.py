"""Traversal under an evidence policy."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.identity import canonical_json
from causeway.functions.lineage import cut
from causeway.operators.graph import Graph, has_partial_evidence, sorted_evidence
from causeway.operators.traverse import ids_like, known, path_between, search, steps_of, stored

POLICY_SCHEMA_VERSION = "causeway.policy/1"
LISTS = ("edge_kinds", "node_kinds", "methods", "origins", "authorities", "states", "stop_node_kinds")


@dataclass(frozen=True)
class TraversalPolicy:
    """What may be followed. An empty list leaves its aspect unrestricted; unknown
    values match nothing."""

    direction: str = "out"
    edge_kinds: tuple[str, ...] = ()
    node_kinds: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    authorities: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    stop_node_kinds: tuple[str, ...] = ()
    max_depth: int = 64
    max_nodes: int = 10_000

    def __post_init__(self):
        if self.direction not in ("in", "out", "both"):
            raise ValueError(f"unknown direction {self.direction!r}")
        for name in LISTS:
            value = getattr(self, name)
            if isinstance(value, str) or any(not isinstance(v, str) or not v for v in value):
                raise ValueError(f"{name} is a list of non-empty strings")
            object.__setattr__(self, name, tuple(sorted(set(value))))
        for name, least in (("max_depth", 0), ("max_nodes", 1)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < least:
                raise ValueError(f"{name} is an integer of at least {least}")

    def serialize(self) -> str:
        return canonical_json({"schemaVersion": POLICY_SCHEMA_VERSION} | {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()})

    @staticmethod
    def parse(text: str) -> TraversalPolicy:
        doc = json.loads(text)
        if not isinstance(doc, dict) or doc.pop("schemaVersion", None) != POLICY_SCHEMA_VERSION:
            raise ValueError("not a policy of this version")
        return TraversalPolicy(**{k: tuple(v) if k in LISTS else v for k, v in doc.items()})

    def matching(self, provenance: Column) -> Column:
        """The records that satisfy all evidence lists by themselves."""

        def ok(p: Column) -> Column:
            test = F.lit(True)
            for field, allowed in (("method", self.methods), ("origin", self.origins), ("state", self.states), ("authority", self.authorities)):
                if allowed:
                    test = test & F.coalesce(p[field].isin(*allowed), F.lit(False))
            return test

        return F.filter(provenance, ok)


def matching_facts(facts: DataFrame, policy: TraversalPolicy) -> DataFrame:
    """Facts with their records that satisfy the policy; those without one leave. Merged,
    they are what the policy matches of the merged facts, and much less is merged."""
    return facts.withColumn("provenance", policy.matching(F.col("provenance"))).where(F.size("provenance") > 0)


def policy_steps(g: Graph, policy: TraversalPolicy, ordered: bool = True) -> DataFrame:
    """Stored steps that the policy allows by edge kind and evidence, filtered once for all
    levels; which kinds of nodes they may enter is ``_enter``."""
    return stored(steps_of(Graph(g.nodes, matching_facts(g.edges, policy), g.diagnostics), policy.direction, list(policy.edge_kinds)), ordered)


def _enter(g: Graph, policy: TraversalPolicy) -> DataFrame:
    return known(g.nodes.where(F.col("kind").isin(*policy.node_kinds)) if policy.node_kinds else g.nodes)


def _closed(g: Graph, policy: TraversalPolicy) -> DataFrame | None:
    return g.nodes.where(F.col("kind").isin(*policy.stop_node_kinds)).select("id") if policy.stop_node_kinds else None


def traverse(g: Graph, start: str, policy: TraversalPolicy) -> tuple[DataFrame, bool, bool]:
    """(reasons, truncated, partial): one row (id, depth, parent, edge_id,
    matched) per node reached; partial also where any of the graph's evidence is."""
    starts = g.nodes.where(F.col("id") == start).select("id")
    if not starts.head(1):
        raise ValueError(f"no node {start}")
    found = search(policy_steps(g, policy), starts, policy.max_depth, policy.max_nodes, closed=_closed(g, policy), enter=_enter(g, policy))
    evidence = g.edges.select(F.col("id").alias("edge_id"), policy.matching(F.col("provenance")).alias("matched"))
    reasons = found.nodes.join(evidence, "edge_id").select("id", "depth", "parent", "edge_id", "matched")
    if not g.merged:  # records of the edges found, each once
        records = reasons.select("id", "depth", "parent", "edge_id", F.explode("matched").alias("p")).groupBy("id", "depth", "parent", "edge_id")
        reasons = records.agg(F.collect_set("p").alias("matched")).withColumn("matched", sorted_evidence("matched"))
    partial = found.truncated or bool(has_partial_evidence(g).first().partial)
    return reasons, found.truncated, partial


def depths(g: Graph, start: str, policy: TraversalPolicy) -> DataFrame:
    """(id, depth) of all that ``traverse`` reaches when no bound of nodes holds;
    levels then need no order and evidence is read once."""
    starts = g.nodes.where(F.col("id") == start).select("id")
    return search(policy_steps(g, policy, ordered=False), starts, policy.max_depth, None, closed=_closed(g, policy), ordered=False, enter=_enter(g, policy)).nodes


def explain(g: Graph, start: str, target: str, policy: TraversalPolicy) -> list[tuple[str, str]] | None:
    """A shortest path that the policy allows. A stop kind may be the target, but
    is not passed; ``max_nodes`` does not count."""
    known = {r.id for r in g.nodes.where(F.col("id").isin(start, target)).select("id").collect()}
    if missing := {start, target} - known:
        raise ValueError(f"no node {sorted(missing)[0]}")
    if start == target:
        return []
    steps, closed = policy_steps(g, policy), _closed(g, policy)
    if closed is not None:  # no way leads on from there
        shut = closed.where(F.col("id") != start)
        steps = cut(steps.join(ids_like(shut, steps).withColumnRenamed("id", "at"), "at", "left_anti"), "steps")
    return path_between(steps, start, target, policy.max_depth, _enter(g, policy))
