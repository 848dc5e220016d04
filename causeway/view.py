"""A layout of a bounded slice, and its SVG."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window as W, functions as F

from causeway.operators.graph import Graph
from causeway.operators.traverse import oriented, search

COLUMN, ROW = 260, 110  # fixed values
BOX = (190, 56)


def layout(g: Graph, root: str) -> DataFrame:
    """(id, x, y): columns by undirected distance from the root, rows by id;
    what the root doesn't reach stands one column further."""
    steps = oriented(g, "both")
    start = g.nodes.where(F.col("id") == root).select("id")
    found = search(steps, start, max_nodes=None).nodes.select("id", "depth").unionByName(start.withColumn("depth", F.lit(0)))
    last = found.agg(F.max("depth")).first()[0] or 0
    placed = g.nodes.select("id").join(found, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(last + 1)))
    row = F.row_number().over(W.partitionBy("depth").orderBy("id")) - 1
    return placed.select("id", (F.col("depth") * COLUMN).cast("long").alias("x"), (row * ROW).cast("long").alias("y"))


def evidence_summary(facts: DataFrame) -> DataFrame:
    """(id, origins, methods, states, authorities): what a fact's evidence says,
    each list sorted and without repeats."""
    named = {"origins": "origin", "methods": "method", "states": "state", "authorities": "authority"}
    values = lambda field: F.array_sort(F.array_distinct(F.array_compact(F.transform("provenance", lambda p: p[field]))))
    return facts.select("id", *[values(field).alias(name) for name, field in named.items()])


def model(g: Graph, root: str, hops: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view: id, kind, key, label, x, y, causal, reference_only; and
    id, kind, src, dst, causal with what their evidence says.

    With the ``hops`` [(edge, node)] of an explanation from ``root`` only its edges are
    shown, each once; they and their ends are causal. Ids that edges name but the graph
    lacks are shown too, as references only.
    """
    spark = g.nodes.sparkSession
    edges = g.edges.withColumn("causal", F.lit(False))
    ways = [root]
    if hops is not None:
        shown = spark.createDataFrame([(e,) for e, _ in hops], "id string").distinct()
        edges = g.edges.join(shown, "id", "left_semi").withColumn("causal", F.lit(True))
        ways += [n for _, n in hops]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    on_way = spark.createDataFrame([(n,) for n in ways], "id string").distinct()
    ids = ends.unionByName(on_way) if hops is not None else ends.unionByName(on_way).unionByName(g.nodes.select("id"))
    known = g.nodes.select("id", "kind", "key", "metadata", F.lit(True).alias("there"))
    own = F.get_json_object("metadata", "$.label")
    label = F.when(F.length(own) > 0, own).when(F.col("there"), F.concat_ws(": ", "kind", "key")).otherwise(F.col("id"))
    causal = on_way.select("id", F.lit(hops is not None).alias("on_way"))
    nodes = ids.distinct().join(known, "id", "left").join(causal, "id", "left").select("id", "kind", "key", label.alias("label"), F.coalesce("on_way", F.lit(False)).alias("causal"), F.col("there").isNull().alias("reference_only"))
    placed = layout(Graph(nodes, edges, g.diagnostics), root)
    return nodes.join(placed, "id"), edges.select("id", "kind", "src", "dst", "causal").join(evidence_summary(edges), "id")


def svg(g: Graph, root: str) -> str:
    """The slice as SVG; for graphs that a person can look at."""
    at = {r.id: (r.x, r.y) for r in layout(g, root).collect()}
    label = {r.id: f"{r.kind}: {r.key}" for r in g.nodes.select("id", "kind", "key").collect()}
    w, h = BOX
    lines = [f'<line x1="{at[e.src][0] + w}" y1="{at[e.src][1] + h // 2}" x2="{at[e.dst][0]}" y2="{at[e.dst][1] + h // 2}" stroke="#888"/>' for e in g.edges.select("src", "dst").orderBy("src", "dst").collect() if e.src in at and e.dst in at]
    boxes = [f'<g transform="translate({x},{y})"><rect width="{w}" height="{h}" fill="#fff" stroke="#333"/><text x="8" y="32">{escape(label[i])}</text></g>' for i, (x, y) in sorted(at.items())]
    right, bottom = max(x for x, _ in at.values()) + w, max(y for _, y in at.values()) + h
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {right} {bottom}">{"".join(lines + boxes)}</svg>\n'
