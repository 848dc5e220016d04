"""Bounded questions over a graph, one join per level.

A level-synchronous search gives what a first-in-first-out search with
neighbours in (node, edge) order gives: each new node keeps the smallest
(position of its parent, edge), and the new positions follow (parent's position,
node). Positions need an order only, not a count, so they come from a range
partition and never from one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, Window as W

from causeway.functions.identity import edge_id, is_whole, packed, unpacked
from causeway.functions.lineage import cut, settle
from causeway.operators.graph import Graph

MAX_DEPTH = 1 << 30
MAX_NODES = 10_000
#: Levels below this many nodes are small; those of more, up to MOST a shuffle partition, are
#: hashed in the tasks that read the steps, which then are not sorted.
SMALL, MOST = 200_000, 1_000_000
FEW = 2


@dataclass(frozen=True)
class Slice:
    """``nodes``: id, depth, parent, edge_id and pos of what was reached (the
    start excluded); ``truncated``: something lies beyond the bounds."""

    nodes: DataFrame
    truncated: bool


def steps_of(g: Graph, direction: str = "out", edge_kinds: list[str] | None = None, extra: list[Column] = ()) -> DataFrame:
    """(at, to, edge_id, ...): edges as steps, dangling ones too; searches leave these out
    when they are told the nodes to ``enter``. Steps of facts have (kind, edge_key, out) in
    place of edge_id: searches make it for the steps that they take."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    edges = g.edges.where(F.col("kind").isin(*edge_kinds)) if edge_kinds else g.edges
    own = lambda out: [F.col("id").alias("edge_id")] if g.merged else ["kind", "edge_key", F.lit(out).alias("out")]
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), *own(True), *extra)
    into = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), *own(False), *extra)
    steps = {"out": out, "in": into}.get(direction)
    return out.unionByName(into) if steps is None else steps


def oriented(g: Graph, direction: str = "out", edge_kinds: list[str] | None = None, enter: DataFrame | None = None, extra: list[Column] = ()) -> DataFrame:
    """(at, to, edge_id, ...): edges as steps to nodes of the graph, or to those of
    ``enter`` (id); dangling ones are left out."""
    steps = steps_of(g, direction, edge_kinds, extra)
    steps = _named(steps).select("at", "to", "edge_id", *steps.columns[5:]) if not g.merged else steps
    there = (g.nodes if enter is None else enter).select(F.col("id").alias("to"))
    return steps.join(there, "to", "left_semi").select("at", "to", "edge_id", *steps.columns[3:])


def stored(steps: DataFrame, ordered: bool = True) -> DataFrame:
    """``steps`` written once, their ids ``packed``; without ``ordered`` only (at, to), for
    searches that ask for depths. Where some ids stand whole and order matters, all are
    read back as texts."""
    steps = steps if ordered else steps.select("at", "to")
    ids = [c for c in steps.columns if c in ("at", "to", "edge_id")]
    whole = Observation()
    small = steps.withColumns({c: packed(c) for c in ids}).observe(whole, *[F.count_if(is_whole(F.col(c))).alias(c) for c in ids])
    out = cut(small, "steps")
    settle(steps.sparkSession)  # the merge and the joins behind the steps
    return _texts(out, *ids) if ordered and any(whole.get.values()) else out


def _named(near: DataFrame) -> DataFrame:
    """Steps with the ids of their edges, made where the steps are of facts."""
    if "edge_id" in near.columns:
        return near
    at, to = (unpacked(c) if kind == "binary" else F.col(c) for c, kind in near.select("at", "to").dtypes)
    made = edge_id("kind", F.when(F.col("out"), at).otherwise(to), F.when(F.col("out"), to).otherwise(at), "edge_key")
    return near.withColumn("edge_id", packed(made) if dict(near.dtypes)["to"] == "binary" else made)


def ids_like(ids: DataFrame, steps: DataFrame, *more: str) -> DataFrame:
    """``ids`` (id, ...) in the form that the ids of ``steps`` have."""
    have, want = dict(ids.dtypes)["id"], dict(steps.dtypes)["to"]
    return ids.select("id" if have == want else (packed("id") if want == "binary" else unpacked("id")).alias("id"), *more)


def _texts(found: DataFrame, *columns: str) -> DataFrame:
    """``found`` with its packed ids as texts."""
    return found.withColumns({c: unpacked(c) for c in columns if dict(found.dtypes)[c] == "binary"})


def known(nodes: DataFrame) -> DataFrame:
    """The ids of ``nodes``, for searches to ``enter``: written once, ``packed``."""
    return cut(nodes.select(packed("id").alias("id")), "known")


def _from_level(level: DataFrame, n: int) -> DataFrame:
    """A level of ``n`` nodes as the side of a join with steps: small ones are broadcast,
    larger ones hashed, and only what no task can hold is sorted with all steps."""
    most = MOST * int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return level.hint("shuffle_hash") if SMALL < n <= most else level


def neighbors(g: Graph, starts: DataFrame, direction: str = "out", edge_kinds: list[str] | None = None) -> DataFrame:
    """(start, id, edge_id): one step from each of ``starts`` (id); a self-loop
    gives the start itself."""
    steps = oriented(g, direction, edge_kinds)
    return steps.join(starts.select(F.col("id").alias("at")).distinct(), "at").select(F.col("at").alias("start"), F.col("to").alias("id"), "edge_id").distinct()


def search(steps: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int | None = MAX_NODES, target: str | None = None, closed: DataFrame | None = None, ordered: bool = True, enter: DataFrame | None = None) -> Slice:
    """Breadth-first search along ``steps`` (at, to, edge_id) from ``starts`` (id).

    ``closed`` (id) are nodes that may be reached but not passed; with ``enter`` (id, each
    once) only its nodes are reached, which is looked up for what a level arrives at and
    not for every step. ``steps`` may be ``stored``. With a
    ``target`` the search ends at the level that reaches it. Steps are read once
    per level; each level is written to the shared folder. Where only depths
    matter and ``max_nodes`` is None, ``ordered`` can be off: ``steps`` then are (at, to),
    levels need no range partition, and no parents and edges are told.
    """
    if not ordered and max_nodes is not None:
        raise ValueError("a bound of nodes needs their order")
    if max_depth < 0 or max_nodes is not None and max_nodes < 1:
        raise ValueError("bounds must not be negative")
    spark = steps.sparkSession
    empty = "id string, depth int, parent string, edge_id string, pos long, open boolean"
    seen = ids_like(starts, steps).distinct()
    frontier = cut(seen.withColumn("pos", F.lit(0).cast("long")).withColumn("open", F.lit(True)), "level")
    seen, levels, left, truncated = frontier.select("id"), [], max_nodes, False
    closed = None if closed is None else ids_like(closed, steps)
    enter = None if enter is None else ids_like(enter, steps)
    depth = n = 0
    while True:
        level = _from_level(frontier.where("open").select(F.col("id").alias("at"), *(["pos"] if ordered else [])), n)
        near = steps.join(level, "at")
        if depth >= max_depth:
            beyond = near.select(F.col("to").alias("id"))
            if enter is not None:
                beyond = cut(beyond.distinct(), "near").join(enter, "id")
            truncated = bool(beyond.join(seen, "id", "left_anti").head(1))
            break
        if ordered:  # partial minima keep a hub's many arrivals out of the shuffle
            new = _named(near).groupBy(F.col("to").alias("id")).agg(F.min(F.struct("pos", "edge_id", F.col("at").alias("parent"))).alias("by"))
        else:
            new = near.select(F.col("to").alias("id")).distinct()
        if enter is not None:  # written, few arrivals are broadcast to the nodes, and no join goes down to all steps
            new = cut(new, "near").join(enter, "id")
        new = new.join(seen, "id", "left_anti")
        if ordered:
            order = ["by.pos", "id"]
            new = cut(new, "new")  # range bounds are drawn from the level alone, not from the join again
            level = new.repartitionByRange(*order).sortWithinPartitions(*order)
            level = level.select("id", F.lit(depth + 1).alias("depth"), "by.parent", "by.edge_id", F.monotonically_increasing_id().alias("pos"))
        else:
            level = new.withColumn("depth", F.lit(depth + 1))
        level = level.withColumn("open", F.lit(True)) if closed is None else level.join(closed.select("id", F.lit(False).alias("shut")), "id", "left").withColumn("open", F.col("shut").isNull()).drop("shut")
        counted = Observation()
        level = cut(level.observe(counted, F.count(F.lit(1)).alias("n")), "level")
        if not (n := counted.get["n"]):
            break
        if left is not None and n > left:
            truncated = True
            level = level.orderBy("pos").limit(left)
            levels.append(level)
            break
        levels.append(level)
        left = None if left is None else left - n
        if target is not None and _texts(level, "id").where(F.col("id") == target).head(1):
            break
        if n > SMALL:
            settle(spark)  # shuffled steps of this level
        depth += 1
        seen = seen.unionByName(level.select("id"))
        if depth % 8 == 0:
            seen = cut(seen, "seen")
        frontier = level
    out = levels[0] if levels else spark.createDataFrame([], empty)
    for level in levels[1:]:
        out = out.unionByName(level)
    return Slice(_texts(out, *["id", "parent", "edge_id"]).select("id", "depth", "parent", "edge_id", "pos") if ordered else _texts(out, "id").select("id", "depth"), truncated)


def closure(g: Graph, start: str, direction: str = "out", edge_kinds: list[str] | None = None, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Slice:
    """All nodes reachable from ``start`` within the bounds, each with the edge
    that reached it first."""
    starts = g.nodes.where(F.col("id") == start).select("id")
    if not starts.head(1):
        raise ValueError(f"no node {start}")
    steps = steps_of(g, direction, edge_kinds)
    # facts lie in tables, and a search of few levels reads them there
    return search(steps if not g.merged and max_depth <= FEW else stored(steps), starts, max_depth, max_nodes, enter=known(g.nodes))


def affected(g: Graph, start: str, edge_kinds: list[str] | None = None, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Slice:
    """What depends on ``start``: its closure against the edges' direction."""
    return closure(g, start, "in", edge_kinds, max_depth, max_nodes)


def reach(steps: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, enter: DataFrame | None = None) -> DataFrame:
    """(id, depth) of all nodes reachable from many starts at once."""
    return search(steps, starts, max_depth, None, ordered=False, enter=enter).nodes


def reach_each(steps: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """(seed, id, depth): for each of ``seeds`` (id) what a search of its own reaches
    first, at most ``max_nodes`` nodes besides the seed.

    All seeds share each level's join. A seed that has its nodes leaves the frontier, so a
    level holds ``max_nodes`` rows of a seed at most; before they are ranked, each part
    of a seed's arrivals is cut to that number, so none is ranked whole.
    """
    spark = steps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = cut(steps, "steps")
    frontier = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("pos", F.lit(0)), "each")
    seen, found, depth = frontier.select("seed", "id"), spark.createDataFrame([], "seed string, id string, depth int"), 0
    room = frontier.select("seed", F.lit(max_nodes).cast("long").alias("left"))
    while depth < max_depth:
        depth += 1
        near = steps.join(frontier.select("seed", F.col("id").alias("at"), "pos"), "at").select("seed", F.col("to").alias("id"), F.struct("pos", "edge_id").alias("by"))
        new = near.groupBy("seed", "id").agg(F.min("by").alias("by")).join(seen, ["seed", "id"], "left_anti").join(room.where("left > 0"), "seed")
        order = [F.col("by.pos"), F.col("id")]
        for part in ("seed", F.pmod(F.xxhash64("id"), F.lit(parts))), ("seed",):
            new = new.withColumn("pos", F.row_number().over(W.partitionBy(*part).orderBy(*order))).where("pos <= left")
        frontier = cut(new.select("seed", "id", "pos"), "each")
        if not frontier.head(1):
            break
        found = found.unionByName(frontier.select("seed", "id", F.lit(depth).alias("depth")))
        taken = frontier.groupBy("seed").agg(F.count("*").alias("n"))
        room = cut(room.join(taken, "seed", "left").select("seed", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "room")
        seen = seen.unionByName(frontier.select("seed", "id"))
        if depth % 8 == 0:
            seen = cut(seen, "seen")
    return found


def trail(pointers: DataFrame, start: str, length: int) -> list[tuple[str, str, str]]:
    """[(id, edge_id, to)]: the first ``length`` hops from ``start`` along ``pointers``
    (id, to, edge_id), one for each id.

    Pointers double: after k rounds they span 2^k hops, and the nodes known to lie on
    the way are twice as many, so a path of n hops takes log2(n) joins.
    """
    on = pointers.sparkSession.createDataFrame([(start, 0)], "id string, pos long")
    jump, span = pointers.select("id", "to"), 1
    while span < length:
        on = on.unionByName(on.join(jump, "id").select(F.col("to").alias("id"), (F.col("pos") + span).alias("pos")))
        span *= 2
        if span < length:
            jump = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "jumps")
            on = cut(on, "trail")
    rows = on.where(F.col("pos") < length).join(pointers, "id").select("pos", "id", "edge_id", "to").collect()
    return [(r.id, r.edge_id, r.to) for r in sorted(rows, key=lambda r: r.pos)]


def path_back(found: DataFrame, start: str, target: str) -> list[tuple[str, str]]:
    """[(edge_id, node)] from ``start`` to ``target`` along the first edges of a
    search's nodes; [] if it did not reach the target."""
    last = found.where(F.col("id") == target).select("depth").first()
    if last is None:
        return []
    hops = trail(found.select("id", F.col("parent").alias("to"), "edge_id"), target, last.depth)
    return [(edge, at) for at, edge, _ in reversed(hops)]


def path_between(steps: DataFrame, start: str, target: str, max_depth: int = MAX_DEPTH, enter: DataFrame | None = None) -> list[tuple[str, str]] | None:
    """[(edge_id, node)] of the shortest path along ``steps`` (which may be ``stored``) that
    a first-in-first-out search finds first, or None. With ``enter`` (id, each once) only
    its nodes, besides the start, lie on the path.

    That path has the least sequence of nodes, and between them the least edges. The search
    goes from both ends, always on the side whose last level is smaller. Forward levels
    keep their order, backward ones the least next node of each; the levels meet at a
    node on a shortest path, and of several the first in forward order has the least way
    to it, whence the least next nodes lead on.
    """
    spark = steps.sparkSession
    if enter is not None:
        if not _texts(enter.select("id"), "id").where(F.col("id") == target).head(1):
            return None
        also = spark.createDataFrame([(start,)], "id string")
        enter = ids_like(enter.select("id"), steps).unionByName(ids_like(also, steps)).distinct()
        enter = cut(enter, "enter")
    first = lambda end: ids_like(spark.createDataFrame([(end, 0)], "id string, pos long"), steps, "pos")
    sides = {forward: {"level": first(end), "n": 1, "depth": 0, "found": []} for forward, end in ((True, start), (False, target))}
    for side in sides.values():
        side["seen"] = side["level"].select("id")
    while sides[True]["depth"] + sides[False]["depth"] < max_depth:
        forward = sides[True]["n"] <= sides[False]["n"]
        own = sides[forward]
        here, there = ("at", "to") if forward else ("to", "at")
        near = _named(steps.join(_from_level(own["level"].select(F.col("id").alias(here), "pos"), own["n"]), here))
        by = F.struct("pos", "edge_id", F.col("at").alias("next")) if forward else F.struct(F.col("to").alias("next"), "edge_id")
        new = near.select(F.col(there).alias("id"), by.alias("by")).groupBy("id").agg(F.min("by").alias("by"))
        new = new if enter is None else cut(new, "near").join(enter, "id")
        new = new.join(own["seen"], "id", "left_anti")
        if forward:
            new = cut(new, "new").repartitionByRange("by.pos", "id").sortWithinPartitions("by.pos", "id")
        counted = Observation()
        new = new.select("id", F.col("by.next").alias("to"), "by.edge_id", (F.monotonically_increasing_id() if forward else F.lit(0).cast("long")).alias("pos"))
        own["level"] = cut(new.observe(counted, F.count(F.lit(1)).alias("n")), "level")
        own["n"], own["depth"] = counted.get["n"], own["depth"] + 1
        if not own["n"]:
            return None
        own["found"].append(_texts(own["level"].select("id", "to", "edge_id"), "id", "to", "edge_id"))
        own["seen"] = own["seen"].unionByName(own["level"].select("id"))
        if own["depth"] % 8 == 0:
            own["seen"] = cut(own["seen"], "seen")
        if own["n"] > SMALL:
            settle(spark)
        middle = _texts(sides[True]["level"].join(sides[False]["level"].select("id"), "id").agg(F.min_by("id", "pos").alias("id")), "id").first().id
        if middle is not None:
            halves = [trail(reduce(DataFrame.unionByName, x["found"]), middle, x["depth"]) if x["depth"] else [] for x in (sides[True], sides[False])]
            return [(edge, at) for at, edge, _ in reversed(halves[0])] + [(edge, to) for _, edge, to in halves[1]]
    return None


def shortest_path(g: Graph, start: str, target: str, direction: str = "out", edge_kinds: list[str] | None = None, max_depth: int = MAX_DEPTH) -> list[tuple[str, str]] | None:
    """[(edge_id, node)] of a shortest path; [] if the ends are one node; None
    if there is no path."""
    there = {r.id for r in g.nodes.where(F.col("id").isin(start, target)).select("id").collect()}
    if missing := {start, target} - there:
        raise ValueError(f"no node {sorted(missing)[0]}")
    if start == target:
        return []
    return path_between(stored(steps_of(g, direction, edge_kinds)), start, target, max_depth, known(g.nodes))
