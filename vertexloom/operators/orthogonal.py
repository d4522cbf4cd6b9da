"""Boxes and axis-parallel edges: port sides and places, routes with bends, separation of overlapping boxes, measures.

Nodes are boxes with centres x, y and width, height. Sides are n, e, s, w; y grows downward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.ingest import in_range, with_ends
from vertexloom.operators.traversal import fixpoint
from vertexloom.sources.graphs import Graph

BOX = ("x", "y", "width", "height")


def _side(dx: Column, dy: Column) -> Column:
    """The side of a box that faces (dx, dy): the longer direction, horizontal on a tie."""
    return F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, "e").otherwise("w")).otherwise(F.when(dy >= 0, "s").otherwise("n"))


def ports(g: Graph) -> DataFrame:
    """graph_id, eid, end (src or dst), idx, side, position: each edge's ends on the sides that face each other.

    Ends on a side are in order of where the other ends are, then eid; the i-th of k is at (i + 1) / (k + 1).
    """
    ends = with_ends(in_range(g).where("src <> dst"), g.nodes, *BOX)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    one = ends.select("graph_id", "eid", F.lit("src").alias("end"), F.col("src").alias("idx"), _side(dx, dy).alias("side"), F.col("b_x").alias("ox"), F.col("b_y").alias("oy"))
    two = ends.select("graph_id", "eid", F.lit("dst").alias("end"), F.col("dst").alias("idx"), _side(-dx, -dy).alias("side"), F.col("a_x").alias("ox"), F.col("a_y").alias("oy"))
    side = W.Window.partitionBy("graph_id", "idx", "side")
    across = F.when(F.col("side").isin("n", "s"), F.col("ox")).otherwise(F.col("oy"))
    rank = F.row_number().over(side.orderBy(across, "eid", "end"))
    return one.unionByName(two).withColumn("position", rank / (F.count("*").over(side) + 1)).select("graph_id", "eid", "end", "idx", "side", "position")


def port_points(g: Graph, placed: DataFrame) -> DataFrame:
    """placed (from `ports`) with the point x, y on the box's border."""
    own = placed.join(g.nodes.select("graph_id", "idx", *(F.col(c).alias(f"n_{c}") for c in BOX)), ["graph_id", "idx"])
    w, h = F.coalesce("n_width", F.lit(0.0)), F.coalesce("n_height", F.lit(0.0))
    along = F.col("position") - 0.5
    x = F.when(F.col("side") == "e", F.col("n_x") + w / 2).when(F.col("side") == "w", F.col("n_x") - w / 2).otherwise(F.col("n_x") + along * w)
    y = F.when(F.col("side") == "s", F.col("n_y") + h / 2).when(F.col("side") == "n", F.col("n_y") - h / 2).otherwise(F.col("n_y") + along * h)
    return own.select(*placed.columns, x.alias("x"), y.alias("y"))


def routes(g: Graph) -> DataFrame:
    """graph_id, eid, points (array of x, y): from port to port with no, one or two right-angled bends."""
    points = port_points(g, ports(g))
    a, b = (points.where(F.col("end") == e).select("graph_id", "eid", F.col("side").alias(f"{m}side"), F.struct("x", "y").alias(m)) for e, m in (("src", "a"), ("dst", "b")))
    both = a.join(b, ["graph_id", "eid"])
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mx, my = (F.col("a.x") + F.col("b.x")) / 2, (F.col("a.y") + F.col("b.y")) / 2
    level = F.col("aside").isin("e", "w")
    bends = (
        F.when(level & (F.col("a.y") == F.col("b.y")) | ~level & (F.col("a.x") == F.col("b.x")), F.array().cast("array<struct<x:double,y:double>>"))
        .when(level, F.array(p(mx, F.col("a.y")), p(mx, F.col("b.y"))))
        .otherwise(F.array(p(F.col("a.x"), my), p(F.col("b.x"), my)))
    )
    return both.select("graph_id", "eid", F.concat(F.array("a"), bends, F.array("b")).alias("points"))


def route_measures(routed: DataFrame) -> DataFrame:
    """graph_id, bends, length: of all routes of a graph."""
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.abs(F.expr("points")[i]["x"] - F.expr("points")[i - 1]["x"]) + F.abs(F.expr("points")[i]["y"] - F.expr("points")[i - 1]["y"]))
    one = routed.select("graph_id", (F.size("points") - 2).alias("bends"), F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("length"))
    return one.groupBy("graph_id").agg(F.sum("bends").alias("bends"), F.sum("length").alias("length"))


def neighbours_along(nodes: DataFrame, axis: str, gap: float = 0.0) -> DataFrame:
    """graph_id, left, right, gap: boxes whose extents overlap across the axis, in order along it; gap is the least distance
    of their centres. Boxes meet in strips of the mean extent across, and a pair counts in the first strip both share."""
    other, size, across = ("y", "width", "height") if axis == "x" else ("x", "height", "width")
    half = F.coalesce(across, F.lit(0.0)) / 2
    own = nodes.select("graph_id", "idx", F.col(axis).alias("p"), F.coalesce(size, F.lit(0.0)).alias("size"), (F.col(other) - half).alias("lo"), (F.col(other) + half).alias("hi"))
    strip = own.groupBy("graph_id").agg(F.greatest(F.avg(F.col("hi") - F.col("lo")), F.lit(1e-9)).alias("strip"))
    celled = own.join(strip, "graph_id").withColumn("first", F.floor(F.col("lo") / F.col("strip"))).withColumn("cell", F.explode(F.sequence(F.col("first"), F.floor(F.col("hi") / F.col("strip")))))
    a, b = celled.alias("a"), celled.alias("b")
    before = (F.col("a.p") < F.col("b.p")) | ((F.col("a.p") == F.col("b.p")) & (F.col("a.idx") < F.col("b.idx")))
    met = (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.cell") == F.greatest("a.first", "b.first")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi")) & before
    return a.join(b, met).select("a.graph_id", F.col("a.idx").alias("left"), F.col("b.idx").alias("right"), ((F.col("a.size") + F.col("b.size")) / 2 + gap).alias("gap"))


def separated(nodes: DataFrame, constraints: DataFrame, axis: str, compact: bool = False) -> DataFrame:
    """nodes moved along the axis, as little forward as satisfies left + gap <= right for all constraints (graph_id, left,
    right, gap; without cycles): longest paths. compact: from the leftmost place instead of where nodes are."""
    least = nodes.groupBy("graph_id").agg(F.min(axis).alias("__least"))
    start = nodes.join(least, "graph_id").select("graph_id", "idx", (F.col("__least") if compact else F.col(axis)).alias("p"))

    def push(state: DataFrame) -> DataFrame:
        moved = constraints.join(state.withColumnsRenamed({"idx": "left", "p": "at"}), ["graph_id", "left"]).select("graph_id", F.col("right").alias("idx"), (F.col("at") + F.col("gap")).alias("p"))
        return state.unionByName(moved).groupBy("graph_id", "idx").agg(F.max("p").alias("p"))

    found = fixpoint(start, push)
    return nodes.drop(axis).join(found.withColumnRenamed("p", axis), ["graph_id", "idx"]).select(nodes.columns)


def remove_overlaps(nodes: DataFrame, gap: float = 0.0) -> DataFrame:
    """Boxes moved apart along x and then, where they still overlap, along y."""
    wide = separated(nodes, neighbours_along(nodes, "x", gap), "x")
    return separated(wide, neighbours_along(wide, "y", gap), "y")


def pack_components(nodes: DataFrame, components: DataFrame, padding: float = 20.0, ratio: float = 1.0) -> DataFrame:
    """Components' boxes (from the tallest down) side by side in shelves of about equal width, so that the whole has the
    ratio width / height."""
    half = lambda c: F.coalesce(c, F.lit(0.0)) / 2
    own = nodes.join(components, ["graph_id", "idx"])
    box = own.groupBy("graph_id", "component").agg(F.min(F.col("x") - half("width")).alias("x0"), F.min(F.col("y") - half("height")).alias("y0"), (F.max(F.col("x") + half("width")) - F.min(F.col("x") - half("width")) + padding).alias("w"), (F.max(F.col("y") + half("height")) - F.min(F.col("y") - half("height")) + padding).alias("h"))
    whole = W.Window.partitionBy("graph_id")
    order = whole.orderBy(F.desc("h"), "component")
    row = F.greatest(F.max("w").over(whole), F.sqrt(F.sum(F.col("w") * F.col("h")).over(whole) * ratio))
    before = F.sum("w").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    shelved = box.withColumn("shelf", F.floor(F.coalesce(before, F.lit(0.0)) / row))
    at = shelved.withColumn("px", F.coalesce(F.sum("w").over(W.Window.partitionBy("graph_id", "shelf").orderBy(F.desc("h"), "component").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)))
    heights = shelved.groupBy("graph_id", "shelf").agg(F.max("h").alias("tall")).withColumn("py", F.coalesce(F.sum("tall").over(W.Window.partitionBy("graph_id").orderBy("shelf").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)))
    moves = at.join(heights, ["graph_id", "shelf"]).select("graph_id", "component", (F.col("px") - F.col("x0")).alias("__dx"), (F.col("py") - F.col("y0")).alias("__dy"))
    moved = own.join(moves, ["graph_id", "component"])
    return moved.withColumn("x", F.col("x") + F.col("__dx")).withColumn("y", F.col("y") + F.col("__dy")).select(nodes.columns)
