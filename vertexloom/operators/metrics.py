"""Drawing quality: crossings, edge lengths, angles, stress. All per graph_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.functions.geometry import crossing_share, length, segments_cross, segments_meet
from vertexloom.operators.ingest import both_ways, in_range, with_ends
from vertexloom.operators.traversal import all_pairs
from vertexloom.sources.graphs import Graph


def segments(g: Graph) -> DataFrame:
    """Edges with the coordinates of their ends: a_x, a_y, b_x, b_y."""
    return with_ends(in_range(g), g.nodes, "x", "y")


def _cells(lines: DataFrame, most: int) -> DataFrame:
    """lines with cx, cy, one row for each cell of a square grid that a line passes or touches.

    A graph of m edges has about sqrt(m) cells a side, fewer where edges are long, so that an edge has some 8 cells on average;
    `most` at most. Along x a line goes through columns; in each it covers the rows between its heights at the column's sides,
    grown a little so that rounding loses no cell.
    """
    own = lines.withColumn("wx", F.abs(F.col("a_x") - F.col("b_x"))).withColumn("wy", F.abs(F.col("a_y") - F.col("b_y")))
    box = own.groupBy("graph_id").agg(
        F.min(F.least("a_x", "b_x")).alias("x0"), F.min(F.least("a_y", "b_y")).alias("y0"), F.count("*").alias("m"), F.avg(F.greatest("wx", "wy")).alias("long"),
        F.greatest(F.max(F.greatest("a_x", "b_x")) - F.min(F.least("a_x", "b_x")), F.max(F.greatest("a_y", "b_y")) - F.min(F.least("a_y", "b_y")), F.lit(1e-9)).alias("side"),
    )
    many = F.least(F.sqrt("m"), 4 * F.col("side") / F.greatest("long", F.lit(1e-12)), F.lit(float(most)))
    sized = box.select("graph_id", "x0", "y0", (F.col("side") / F.greatest(F.lit(1.0), F.floor(many))).alias("cell"), (F.col("side") * 1e-9).alias("eps"))
    own = own.join(sized, "graph_id")
    right = F.col("b_x") >= F.col("a_x")
    own = own.select("*", *(F.when(right, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("lx", "a_x", "b_x"), ("ly", "a_y", "b_y"), ("rx", "b_x", "a_x"), ("ry", "b_y", "a_y"))))
    column = lambda v: F.floor((v - F.col("x0")) / F.col("cell"))
    row = lambda v: F.floor((v - F.col("y0")) / F.col("cell"))
    own = own.withColumn("cx", F.explode(F.sequence(column(F.col("lx") - F.col("eps")), column(F.col("rx") + F.col("eps")))))
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lx")) / F.nullif("wx", F.lit(0.0))))
    border = F.col("x0") + F.col("cx") * F.col("cell")
    steep = F.col("wx") <= F.col("eps")
    at = lambda v, flat: F.when(steep, flat).otherwise(F.col("ly") + share(v) * (F.col("ry") - F.col("ly")))
    one, two = at(border - F.col("eps"), F.col("ly")), at(border + F.col("cell") + F.col("eps"), F.col("ry"))
    grown = F.col("eps") * (1 + F.when(steep, 0.0).otherwise(F.col("wy") / F.nullif("wx", F.lit(0.0))))
    rows = F.sequence(row(F.least(one, two) - grown), row(F.greatest(one, two) + grown))
    return own.withColumn("cy", F.explode(rows)).select("graph_id", "cx", "cy", "eid", "src", "dst", "a_x", "a_y", "b_x", "b_y")


def _pairs(lines: DataFrame, cells: int, meet: Callable[..., Column]) -> DataFrame:
    """Pairs of edges (p, q) without a common node that `meet`, each once: they share a cell of the grid."""
    celled = _cells(lines, cells)
    p, q = celled.alias("p"), celled.alias("q")
    apart = (F.col("p.src") != F.col("q.src")) & (F.col("p.src") != F.col("q.dst")) & (F.col("p.dst") != F.col("q.src")) & (F.col("p.dst") != F.col("q.dst"))
    same = (F.col("p.graph_id") == F.col("q.graph_id")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))
    both = p.join(q, same & (F.col("p.eid") < F.col("q.eid")) & apart).where(meet(*_ends("p", "q")))
    values = ("eid", "a_x", "a_y", "b_x", "b_y")
    return both.select(F.col("p.graph_id").alias("graph_id"), *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("p", "q") for c in values)).distinct()


def _ends(p: str, q: str) -> list[Column]:
    return [F.col(f"{e}.{c}") for e in (p, q) for c in ("a_x", "a_y", "b_x", "b_y")]


def edge_crossings(g: Graph, cells: int = 4096) -> DataFrame:
    """graph_id, crossings: pairs of edges without a common node that have a point in common (touching counts)."""
    found = _pairs(segments(g), cells, segments_meet).groupBy("graph_id").agg(F.count("*").alias("crossings"))
    return g.nodes.select("graph_id").distinct().join(found, "graph_id", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)).cast("long"))


def crossing_points(g: Graph, cells: int = 4096) -> DataFrame:
    """graph_id, e1, e2, x, y of edges that cross inside both."""
    ends = [F.col(f"{e}_{c}") for e in ("p", "q") for c in ("a_x", "a_y", "b_x", "b_y")]
    hit = _pairs(segments(g), cells, segments_cross).withColumn("t", crossing_share(*ends))
    x, y = F.col("p_a_x") + F.col("t") * (F.col("p_b_x") - F.col("p_a_x")), F.col("p_a_y") + F.col("t") * (F.col("p_b_y") - F.col("p_a_y"))
    return hit.select("graph_id", F.col("p_eid").alias("e1"), F.col("q_eid").alias("e2"), x.alias("x"), y.alias("y"))


def edge_lengths(g: Graph) -> DataFrame:
    return segments(g).select("graph_id", "eid", length(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")).alias("length"))


def length_summary(g: Graph) -> DataFrame:
    """graph_id, variance (of the population, 0 without edges), uniformity (1 - deviation / mean within 0 .. 1; 1 without edges, 0 at mean 0)."""
    own = edge_lengths(g).groupBy("graph_id").agg(F.var_pop("length").alias("v"), F.stddev_pop("length").alias("s"), F.avg("length").alias("m"))
    out = g.nodes.select("graph_id").distinct().join(own, "graph_id", "left")
    even = F.when(F.col("m").isNull(), 1.0).when(F.col("m") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("s") / F.col("m"))))
    return out.select("graph_id", F.coalesce("v", F.lit(0.0)).alias("variance"), even.alias("uniformity"))


def angular_resolution(g: Graph) -> DataFrame:
    """graph_id, angle: the least angle in degrees between directions to distinct neighbours, 360 where there is none.

    Equal directions of two neighbours count as a full turn apart.
    """
    pairs = both_ways(in_range(g).select("graph_id", "src", "dst").where("src <> dst")).distinct()
    turned = with_ends(pairs, g.nodes, "x", "y").select("graph_id", "src", "dst", F.degrees(F.atan2(F.col("b_y") - F.col("a_y"), F.col("b_x") - F.col("a_x"))).alias("angle"))
    ring = W.Window.partitionBy("graph_id", "src").orderBy("angle", "dst")
    whole = W.Window.partitionBy("graph_id", "src")
    nxt = F.coalesce(F.lead("angle").over(ring), F.first("angle").over(ring) + 360)
    gaps = turned.withColumn("n", F.count("*").over(whole)).withColumn("gap", nxt - F.col("angle")).where("n > 1")
    least = gaps.select("graph_id", F.when(F.col("gap") <= 0, F.col("gap") + 360).otherwise(F.col("gap")).alias("gap")).groupBy("graph_id").agg(F.min("gap").alias("angle"))
    return g.nodes.select("graph_id").distinct().join(least, "graph_id", "left").withColumn("angle", F.coalesce("angle", F.lit(360.0)))


def stress(g: Graph, edge_length: float = 100.0, ideal: DataFrame | None = None, hops: bool = False) -> DataFrame:
    """graph_id, stress: sum w (d - D)^2 / sum w D^2 over pairs i < j with w = 1 / D^2; 0 without pairs.

    ideal (graph_id, i, j, d) is given, or shortest paths over length (else edge_length), or hops * edge_length.
    """
    if ideal is None:
        found = all_pairs(g) if hops else all_pairs(g, "length", edge_length)
        ideal = found.select("graph_id", F.col("source").alias("i"), F.col("idx").alias("j"), (F.col("dist") * (edge_length if hops else 1.0)).alias("d"))
    want = ideal.where("i < j and d > 0 and d < double('infinity')").select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    own = with_ends(want, g.nodes, "x", "y").withColumn("l", length(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")))
    total = own.groupBy("graph_id").agg((F.sum(F.pow(F.col("l") - F.col("d"), F.lit(2)) / F.pow("d", F.lit(2))) / F.count("*")).alias("stress"))
    return g.nodes.select("graph_id").distinct().join(total, "graph_id", "left").withColumn("stress", F.coalesce("stress", F.lit(0.0)))


def quality_summary(g: Graph, edge_length: float = 100.0, with_stress: bool = True) -> DataFrame:
    """graph_id, crossings, variance, uniformity, angle and stress."""
    out = edge_crossings(g).join(length_summary(g), "graph_id").join(angular_resolution(g), "graph_id")
    return out.join(stress(g, edge_length), "graph_id") if with_stress else out
