"""Closed-form placements: each takes a Graph and returns its nodes with x and y. Nodes with fixed > 0 keep theirs
where the placement honours that."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.functions.numbers import uniform
from vertexloom.operators.ingest import both_ways, check_canvas, degrees, in_range, sizes
from vertexloom.operators.traversal import longest_path_layers, two_colouring
from vertexloom.plans.lineage import cut
from vertexloom.sources.graphs import Graph


def _placed(nodes: DataFrame, x: Column, y: Column, honour_fixed: bool = True) -> DataFrame:
    free = F.coalesce("fixed", F.lit(0)) == 0 if honour_fixed else F.lit(True)
    rest = [c for c in nodes.columns if c not in ("x", "y") and not c.startswith("__")]
    return nodes.select(*rest, F.when(free, x).otherwise(F.col("x")).alias("x"), F.when(free, y).otherwise(F.col("y")).alias("y"))


def centred(nodes: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Move each graph so that its box's centre is the canvas's; fixed nodes move too."""
    w, h = check_canvas(size)
    box = nodes.groupBy("graph_id").agg(((F.min("x") + F.max("x")) / 2).alias("__cx"), ((F.min("y") + F.max("y")) / 2).alias("__cy"))
    return _placed(nodes.join(box, "graph_id"), F.col("x") + (w / 2 - F.col("__cx")), F.col("y") + (h / 2 - F.col("__cy")), False)


def random_layout(g: Graph, size=(1000.0, 1000.0), margin: float = 0.0, seed: int = 0) -> DataFrame:
    """Uniform in the canvas without its margin (which is left out on an axis that it would use up)."""
    w, h = check_canvas(size)
    mx, my = (margin if 2 * margin < s else 0.0 for s in (w, h))
    return _placed(g.nodes, mx + uniform(seed, 0, F.col("idx")) * (w - 2 * mx), my + uniform(seed, 1, F.col("idx")) * (h - 2 * my))


def _on_circle(rank: Column, count: Column, radius: Column | float, start: float, cx: float, cy: float) -> tuple[Column, Column]:
    angle = F.lit(start) + F.lit(2 * math.pi) * rank / count
    r = F.lit(radius) if isinstance(radius, float) else radius
    return F.lit(cx) + r * F.cos(angle), F.lit(cy) + r * F.sin(angle)


def circular(g: Graph, size=(1000.0, 1000.0), radius: float | None = None, start: float = 0.0, sort_by: str | Column | None = None) -> DataFrame:
    """Equal angles on a circle, in order of idx, of falling degree (sort_by "degree", loops once) or of a column."""
    w, h = check_canvas(size)
    r = radius if radius is not None else max(50.0, min(w, h) / 2 - 50)
    nodes = g.nodes
    if isinstance(sort_by, str) and sort_by == "degree":
        nodes = nodes.join(degrees(g, 1).withColumnRenamed("degree", "__key"), ["graph_id", "idx"]).withColumn("__key", -F.col("__key"))
    elif sort_by is not None:
        nodes = nodes.withColumn("__key", F.col(sort_by) if isinstance(sort_by, str) else sort_by)
    order = W.Window.partitionBy("graph_id").orderBy(*(["__key"] if sort_by is not None else []), "idx")
    ranked = nodes.withColumn("__rank", F.row_number().over(order) - 1).join(sizes(g).withColumnRenamed("n", "__n"), "graph_id")
    return _placed(ranked, *_on_circle(F.col("__rank"), F.col("__n"), float(r), start, w / 2, h / 2))


def shell(g: Graph, size=(1000.0, 1000.0), shells: DataFrame | None = None, auto: int = 0, step: float = 100.0, start: float = 0.0) -> DataFrame:
    """Concentric rings: given (graph_id, idx, ring, pos), with what they leave out on one more ring, or `auto` rings
    by falling degree (loops twice). Without either, one ring. A first ring of one node is the centre; else rings
    grow from step outward; a single ring takes half the smaller side less 50."""
    w, h = check_canvas(size)
    if shells is not None:
        last = shells.groupBy("graph_id").agg(F.max("ring").alias("__last"))
        ringed = g.nodes.join(shells.select("graph_id", "idx", F.col("ring").alias("__ring"), F.col("pos").alias("__pos")), ["graph_id", "idx"], "left").join(last, "graph_id", "left")
        ringed = ringed.withColumn("__pos", F.coalesce("__pos", "idx")).withColumn("__ring", F.coalesce("__ring", F.coalesce("__last", F.lit(-1)) + 1))
    else:
        rank = F.row_number().over(W.Window.partitionBy("graph_id").orderBy(F.desc("__degree"), "idx")) - 1
        ringed = g.nodes.join(degrees(g, 2).withColumnRenamed("degree", "__degree"), ["graph_id", "idx"]).join(sizes(g).withColumnRenamed("n", "__n"), "graph_id").withColumn("__pos", rank)
        ringed = ringed.withColumn("__ring", F.expr(f"cast(__pos * {auto} div __n as int)") if auto > 1 else F.lit(0))
    ring = W.Window.partitionBy("graph_id", "__ring")
    whole = W.Window.partitionBy("graph_id")
    at = ringed.withColumn("__rank", F.row_number().over(ring.orderBy("__pos", "idx")) - 1).withColumn("__count", F.count("*").over(ring)).withColumn("__rings", F.max("__ring").over(whole) + 1).withColumn("__first", F.sum(F.when(F.col("__ring") == 0, 1).otherwise(0)).over(whole))
    radius = F.when(F.col("__rings") == 1, F.when(F.col("__count") == 1, 0.0).otherwise(min(w, h) / 2 - 50)).otherwise((F.col("__ring") + F.when(F.col("__first") == 1, 0).otherwise(1)) * step)
    return _placed(at, *_on_circle(F.col("__rank"), F.col("__count"), radius, start, w / 2, h / 2))


def bipartite(g: Graph, size=(800.0, 600.0), orientation: str = "horizontal", layer_separation: float = 200.0, node_separation: float = 50.0, sweeps: int = 4, sides: DataFrame | None = None) -> DataFrame:
    """Two rows (horizontal) or columns: sides given (graph_id, idx, side) or found; graphs that aren't bipartite are
    halved by idx. `sweeps` times the second side, then the first, is ordered by mean neighbour position."""
    w, h = check_canvas(size)
    if sides is None:
        found = two_colouring(Graph(g.nodes, g.edges.where("src <> dst"))).join(sizes(g), "graph_id")
        sides = found.select("graph_id", "idx", F.when(F.col("bipartite"), F.col("side")).otherwise(F.when(F.col("idx") < F.expr("n div 2"), 0).otherwise(1)).alias("side"))
    order = F.row_number().over(W.Window.partitionBy("graph_id", "side").orderBy("idx")) - 1
    state = sides.withColumn("pos", order.cast("double"))
    for _ in range(sweeps):
        for side in (1, 0):
            state = cut(barycentre_order(g, state, side))
    return _placed(*_rows(g.nodes.join(state.withColumnsRenamed({"side": "__side", "pos": "__pos"}), ["graph_id", "idx"]), orientation, layer_separation, node_separation, w, h))


def barycentre_order(g: Graph, state: DataFrame, side: int) -> DataFrame:
    """state (graph_id, idx, side, pos) with one side in order of the mean position of its neighbours on the other;
    nodes without any keep their own; ties keep their order."""
    edges = both_ways(in_range(g).select("graph_id", "src", "dst").where("src <> dst"))
    other = state.where(F.col("side") != side).select("graph_id", F.col("idx").alias("dst"), F.col("pos").alias("p"))
    mean = edges.join(other, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.avg("p").alias("mean"))
    own = state.where(F.col("side") == side).join(mean, ["graph_id", "idx"], "left").withColumn("key", F.coalesce("mean", "pos"))
    ranked = own.withColumn("pos", (F.row_number().over(W.Window.partitionBy("graph_id").orderBy("key", "pos", "idx")) - 1).cast("double"))
    return ranked.select("graph_id", "idx", "side", "pos").unionByName(state.where(F.col("side") != side).select("graph_id", "idx", "side", "pos"))


def _rows(nodes: DataFrame, orientation: str, between: float, apart: float, w: float, h: float) -> tuple[DataFrame, Column, Column]:
    counted = nodes.withColumn("__n", F.count("*").over(W.Window.partitionBy("graph_id", "__side")))
    across = lambda centre: F.lit(centre) - (F.col("__n") - 1) * apart / 2 + F.col("__pos") * apart
    along = lambda centre: F.lit(centre - between / 2) + F.col("__side") * between
    return (counted, across(w / 2), along(h / 2)) if orientation == "horizontal" else (counted, along(w / 2), across(h / 2))


def radial_tree(g: Graph, size=(1000.0, 1000.0), level_radius: float = 100.0, start: float = 0.0, sweep: float = 2 * math.pi) -> DataFrame:
    """Root (least idx without an incoming edge) in the centre; a subtree's wedge follows from its leaves.

    For forests of one tree per graph, level by level: leaf counts go up, wedge starts come down as running sums
    over siblings in the order of their edges.
    """
    w, h = check_canvas(size)
    edges = in_range(g).where("src <> dst").groupBy("graph_id", "dst").agg(F.min_by(F.struct("eid", "src"), "eid").alias("e")).select("graph_id", F.col("dst").alias("idx"), "e.src", "e.eid")
    level = longest_path_layers(Graph(g.nodes, edges.select("graph_id", "src", F.col("idx").alias("dst"))))
    tree = cut(level.join(edges, ["graph_id", "idx"], "left"))
    depth = tree.agg(F.max("layer")).first()[0] or 0
    leaves = tree.join(tree.select("graph_id", F.col("src").alias("idx")).distinct(), ["graph_id", "idx"], "left_anti").select("graph_id", "idx", F.lit(1).cast("long").alias("leaves"))
    for d in range(depth - 1, -1, -1):
        up = tree.where(F.col("layer") == d + 1).join(leaves, ["graph_id", "idx"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.sum("leaves").alias("leaves"))
        leaves = cut(leaves.unionByName(up))
    own = cut(tree.join(leaves, ["graph_id", "idx"]))
    before = W.Window.partitionBy("graph_id", "src").orderBy("eid").rowsBetween(W.Window.unboundedPreceding, -1)
    siblings = own.withColumn("skip", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
    placed = siblings.where("layer = 0").select("graph_id", "idx", "layer", "leaves", F.lit(start).alias("a"), F.lit(sweep).alias("s"))
    rows = placed
    for d in range(1, depth + 1):
        parent = placed.select("graph_id", F.col("idx").alias("src"), F.col("a").alias("pa"), F.col("s").alias("ps"), F.col("leaves").alias("pl"))
        placed = siblings.where(F.col("layer") == d).join(parent, ["graph_id", "src"]).select("graph_id", "idx", "layer", "leaves", (F.col("pa") + F.col("ps") * F.col("skip") / F.col("pl")).alias("a"), (F.col("ps") * F.col("leaves") / F.col("pl")).alias("s"))
        rows = rows.unionByName(placed)
    mid, r = F.col("__a") + F.col("__s") / 2, F.col("__l") * level_radius
    both = g.nodes.join(rows.select("graph_id", "idx", F.col("layer").alias("__l"), F.col("a").alias("__a"), F.col("s").alias("__s")), ["graph_id", "idx"])
    return _placed(both, w / 2 + r * F.cos(mid), h / 2 + r * F.sin(mid), False)
