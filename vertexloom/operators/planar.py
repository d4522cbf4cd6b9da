"""Drawings as planar maps: edges cut at crossings, faces, blocks and bridges, hulls, boxes of groups, parallel lanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.components import component_labels
from vertexloom.operators.cores import by_core
from vertexloom.operators.ingest import in_range, sizes, with_ends
from vertexloom.operators.metrics import crossing_points
from vertexloom.operators.traversal import components, distances, peel
from vertexloom.operators.trees import below, spanning_forest, tours
from vertexloom.plans.lineage import cleaning, cut, kept
from vertexloom.sources.graphs import Graph

LARGE = 200_000  # edges from which on blocks are found by way of a core


def planarized(g: Graph, cells: int = 64) -> Graph:
    """The drawing with a node at every crossing: nodes graph_id, idx, x, y, crossing (e1, e2 or null; numbered on from n
    by e1, e2); edges graph_id, eid, part, src, dst: the pieces of each edge from its src on."""
    number = F.row_number().over(W.Window.partitionBy("graph_id").orderBy("e1", "e2")) - 1
    found = cut(crossing_points(g, cells).join(sizes(g), "graph_id").withColumn("idx", (F.col("n") + number).cast("long")).drop("n"))
    nodes = g.nodes.select("graph_id", "idx", "x", "y", F.lit(None).cast("struct<e1:bigint,e2:bigint>").alias("crossing"))
    nodes = nodes.unionByName(found.select("graph_id", "idx", "x", "y", F.struct("e1", "e2").alias("crossing")))
    edges = with_ends(in_range(g), g.nodes, "x", "y").select("graph_id", "eid", "src", "dst", "a_x", "a_y", "b_x", "b_y")
    met = found.select("graph_id", F.explode(F.array("e1", "e2")).alias("eid"), "idx", "x", "y").join(edges, ["graph_id", "eid"])
    far = lambda x, y: F.pow(x - F.col("a_x"), F.lit(2)) + F.pow(y - F.col("a_y"), F.lit(2))
    stops = met.select("graph_id", "eid", "idx", far(F.col("x"), F.col("y")).alias("at"))
    stops = stops.unionByName(edges.select("graph_id", "eid", F.col("src").alias("idx"), F.lit(-1.0).alias("at")))
    stops = stops.unionByName(edges.select("graph_id", "eid", F.col("dst").alias("idx"), F.lit(float("inf")).alias("at")))
    along = W.Window.partitionBy("graph_id", "eid").orderBy("at", "idx")
    pieces = stops.withColumn("dst", F.lead("idx").over(along)).withColumn("part", F.row_number().over(along) - 1).where("dst is not null")
    return Graph(nodes, pieces.select("graph_id", "eid", "part", F.col("idx").alias("src"), "dst"))


def faces(g: Graph) -> DataFrame:
    """graph_id, eid, forward, face of each dart (an edge in one direction): the orbits of "turn to the next edge round the
    dart's end", in the drawing's own rotation; a face is named by its least dart (2 * eid, and 1 more if backward). Edges
    that leave a node at one angle follow each other by eid; loops don't take part."""
    ends = with_ends(in_range(g).where("src <> dst"), g.nodes, "x", "y")
    angle = lambda sign: F.atan2(sign * (F.col("b_y") - F.col("a_y")), sign * (F.col("b_x") - F.col("a_x"))).alias("angle")
    out = ends.select("graph_id", (F.col("eid") * 2).alias("dart"), F.col("src").alias("at"), angle(1))
    out = cut(out.unionByName(ends.select("graph_id", (F.col("eid") * 2 + 1).alias("dart"), F.col("dst").alias("at"), angle(-1))))
    around = W.Window.partitionBy("graph_id", "at").orderBy("angle", "dart")
    every = around.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    turn = out.withColumn("next", F.coalesce(F.lead("dart").over(around), F.first("dart").over(every)))
    # who comes in by a dart goes on with the one after its reverse
    links = turn.select("graph_id", F.col("dart").bitwiseXOR(F.lit(1).cast("long")).alias("src"), F.col("next").alias("dst"))
    labels = component_labels(links, keys=("graph_id",))
    return labels.select("graph_id", F.floor(F.col("node") / 2).cast("long").alias("eid"), (F.col("node") % 2 == 0).alias("forward"), F.col("component").alias("face"))


def blocks(g: Graph, large: int = LARGE) -> DataFrame:
    """graph_id, eid, block of each edge but loops: edges on a common cycle are in one block, named by its least eid.

    Of `large` edges and more (all graphs together) those in large blocks are told apart first, from a core (`cores`).
    """
    with cleaning():
        edges = kept(in_range(g).where("src <> dst").select("graph_id", "eid", "src", "dst"))
        return _blocks(edges) if edges.count() < large else by_core(edges, _blocks)


def _blocks(edges: DataFrame) -> DataFrame:
    """`blocks` of edges (graph_id, eid, src, dst) without loops.

    Each edge outside a spanning forest closes a cycle with tree edges. Ends that aren't above each other put the tree
    edges above both into one block; a tree edge is in one with that of its parent if an edge outside the forest leads
    from below it to beyond the parent, which the least and greatest places below it tell. So the links are no more than the
    edges, and rounds grow with the logarithm of the nodes, on long paths too (`trees`).
    """
    tree, labels = spanning_forest(edges)
    tour = tours(edges.join(tree, ["graph_id", "eid"]), labels)
    # a root has no edge above, and is above all
    roots = labels.where("node = root").select("graph_id", "node", F.lit(None).cast("long").alias("up"), F.lit(-1).cast("long").alias("first"), F.lit((1 << 63) - 1).alias("last"))
    nodes = kept(tour.select("graph_id", "node", F.col("eid").alias("up"), "first", "last").unionByName(roots))
    end = lambda name, own: nodes.select("graph_id", F.col("node").alias(name), F.struct("first", "last", "up", "node").alias(own))
    rest = edges.join(tree, ["graph_id", "eid"], "left_anti").join(end("src", "s"), ["graph_id", "src"]).join(end("dst", "d"), ["graph_id", "dst"])
    rest = kept(rest.select("graph_id", "eid", F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")))  # a comes first
    met = rest.select("graph_id", F.col("a.node").alias("node"), F.col("b.first").alias("place"))
    met = met.unionByName(rest.select("graph_id", F.col("b.node").alias("node"), F.col("a.first").alias("place"))).unionByName(nodes.select("graph_id", "node", F.col("first").alias("place")))
    reach = below(tour, met.groupBy("graph_id", "node").agg(F.min("place").alias("low"), F.max("place").alias("high")))
    over = nodes.select("graph_id", F.col("node").alias("parent"), F.col("up").alias("above"), F.col("first").alias("f"), F.col("last").alias("l")).where("up is not null")
    beyond = tour.join(reach, ["graph_id", "root", "node"]).join(over, ["graph_id", "parent"]).where("low < f or high > l")
    links = beyond.select("graph_id", F.col("eid").alias("src"), F.col("above").alias("dst"))
    links = links.unionByName(rest.where("a.last < b.first").select("graph_id", F.col("a.up").alias("src"), F.col("b.up").alias("dst")))
    joined = component_labels(links, keys=("graph_id",)).select("graph_id", F.col("node").alias("up"), "component")
    every = tree.select("graph_id", "eid", F.col("eid").alias("up")).unionByName(rest.select("graph_id", "eid", F.col("b.up").alias("up")))
    every = kept(every.join(joined, ["graph_id", "up"], "left").select("graph_id", "eid", F.coalesce("component", "up").alias("of")))
    names = every.groupBy("graph_id", "of").agg(F.min("eid").alias("block"))
    return every.join(names, ["graph_id", "of"]).select("graph_id", "eid", "block")


def bridges(g: Graph) -> DataFrame:
    """graph_id, eid of edges on no cycle."""
    found = blocks(g)
    alone = found.groupBy("graph_id", "block").agg(F.count("*").alias("edges")).where("edges = 1")
    return alone.select("graph_id", F.col("block").alias("eid"))


def block_cut_tree(g: Graph) -> DataFrame:
    """graph_id, idx, block: the blocks of each node with edges; nodes of several blocks are the cut vertices."""
    ends = blocks(g).join(in_range(g).select("graph_id", "eid", "src", "dst"), ["graph_id", "eid"])
    return ends.select("graph_id", F.explode(F.array("src", "dst")).alias("idx"), "block").distinct()


def cut_vertices(g: Graph) -> DataFrame:
    """graph_id, idx of nodes whose loss disconnects their component."""
    return block_cut_tree(g).groupBy("graph_id", "idx").agg(F.count("*").alias("blocks")).where("blocks > 1").select("graph_id", "idx")


def find_cycle(g: Graph) -> DataFrame:
    """graph_id, src, dst: the edges of one directed cycle of each graph that has one.

    What is left after peeling from the sources has a way back from every node; the least node before each leads, by doubling
    steps, onto cycles, of which the one with the least node is given.
    """
    g = g.settled()
    edges = cut(in_range(g).select("graph_id", "src", "dst"))
    left = cut(peel(Graph(g.nodes, edges)).where("level is null").select("graph_id", "idx"))
    inner = edges.join(left.withColumnRenamed("idx", "src"), ["graph_id", "src"], "left_semi").join(left.withColumnRenamed("idx", "dst"), ["graph_id", "dst"], "left_semi")
    # steps go against the edges: src is where a step starts
    step = cut(inner.groupBy("graph_id", F.col("dst").alias("src")).agg(F.min("src").alias("dst")))
    jump, most = step, step.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        far = jump.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
        jump = cut(jump.join(far, ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")))
    on = jump.select("graph_id", F.col("dst").alias("src")).distinct()
    rings = cut(step.join(on, ["graph_id", "src"], "left_semi"))
    labels = component_labels(rings, keys=("graph_id",))
    first = labels.groupBy("graph_id").agg(F.min("component").alias("component"))
    wanted = labels.join(first, ["graph_id", "component"]).select("graph_id", F.col("node").alias("src"))
    return rings.join(wanted, ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def farthest(g: Graph, sources: DataFrame) -> DataFrame:
    """graph_id, source, idx, dist: the node most hops away from each source (graph_id, source), the least of these."""
    best = distances(g, sources).groupBy("graph_id", "source").agg(F.max(F.struct("dist", (-F.col("idx")).alias("back"))).alias("b"))
    return best.select("graph_id", "source", (-F.col("b.back")).alias("idx"), F.col("b.dist").alias("dist"))


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the hull's corners, counter-clockwise from the leftmost; points on its sides are no corners."""
    order = np.lexsort((y, x))
    if len(order):
        new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))
        order = order[new]

    def chain(points: np.ndarray) -> list[int]:
        out: list[int] = []
        for p in points.tolist():
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[p] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[p] - x[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out

    if len(order) < 3:
        return order
    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1], np.int64)


def convex_hull(nodes: DataFrame) -> DataFrame:
    """graph_id, pos, idx, x, y: the corners of each graph's hull, counter-clockwise from the leftmost (of these the
    lowest). A batch's own hull of each graph goes on, so that few points of a large graph are shuffled."""
    names = ["graph_id", "idx", "x", "y"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).dictionary_encode()
            code, x, y = ids.indices.to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                yield batch.take(pa.array(part[_hull(x[part], y[part])]))

    def whole(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["idx"].to_numpy(), kind="stable")))
        at = _hull(table["x"].to_numpy(), table["y"].to_numpy())
        found = table.take(pa.array(at))
        return found.add_column(1, "pos", pa.array(np.arange(len(at)), pa.int32()))

    own = nodes.where("x is not null and y is not null").select(F.coalesce("graph_id", F.lit("")).alias("graph_id"), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = "graph_id string, idx long, x double, y double"
    return own.mapInArrow(partial, schema).groupBy("graph_id").applyInArrow(whole, "graph_id string, pos int, idx long, x double, y double").select("graph_id", "pos", *names[1:])


def group_bounds(nodes: DataFrame, groups: DataFrame, padding: float = 10.0, max_depth: int = 64) -> DataFrame:
    """graph_id, gid, x0, y0, x1, y1 of each group (graph_id, gid, leaves, children): the box round its leaves' boxes and its
    children's, with the padding; groups without any are left out. Groups nested deeper than max_depth raise."""
    half = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 2
    leaf = groups.select("graph_id", "gid", F.explode("leaves").alias("idx")).join(nodes, ["graph_id", "idx"])
    leaf = leaf.select("graph_id", "gid", (F.col("x") - half("width")).alias("x0"), (F.col("y") - half("height")).alias("y0"), (F.col("x") + half("width")).alias("x1"), (F.col("y") + half("height")).alias("y1"))
    box = lambda df: df.groupBy("graph_id", "gid").agg((F.min("x0")).alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    wide = lambda df: df.select("graph_id", "gid", *((F.col(c) + s * padding).alias(c) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    inside = cut(groups.select("graph_id", "gid", F.explode("children").alias("child")))
    leaf = cut(leaf)
    found = cut(wide(box(leaf)))
    for _ in range(max_depth):
        below = inside.join(found.withColumnRenamed("gid", "child"), ["graph_id", "child"]).drop("child")
        now = cut(wide(box(leaf.unionByName(below))))
        if now.exceptAll(found).isEmpty():
            return now
        found = now
    raise ValueError(f"groups are nested deeper than {max_depth}, or in themselves")


def lanes(segments: DataFrame, gap: float = 10.0) -> DataFrame:
    """graph_id, eid, seg, offset for axis-parallel segments (graph_id, eid, seg, level, line, lo, hi; level: whether they
    run along x): where segments of one line overlap, they are set side by side, `gap` apart round the line."""
    line = W.Window.partitionBy("graph_id", "level", "line").orderBy("lo", "hi", "eid", "seg")
    reach = F.max("hi").over(line.rowsBetween(W.Window.unboundedPreceding, -1))
    begun = segments.withColumn("new", F.coalesce((F.col("lo") >= reach).cast("int"), F.lit(1)))
    run = begun.withColumn("run", F.sum("new").over(line))
    cluster = W.Window.partitionBy("graph_id", "level", "line", "run")
    place = F.row_number().over(cluster.orderBy("eid", "seg")) - 1
    return run.withColumn("offset", (place - (F.count("*").over(cluster) - 1) / 2) * gap).select("graph_id", "eid", "seg", "offset")


def route_segments(routed: DataFrame, digits: int = 6) -> DataFrame:
    """The inner segments of routes (graph_id, eid, points), as `lanes` takes them."""
    steps = routed.select("graph_id", "eid", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("seg", "s"))
    level = F.col("s.a.y") == F.col("s.b.y")
    pick = lambda end, along: F.when(level, F.col(f"s.{end}.{'x' if along else 'y'}")).otherwise(F.col(f"s.{end}.{'y' if along else 'x'}"))
    out = steps.select("graph_id", "eid", F.col("seg").cast("int").alias("seg"), level.alias("level"), F.round(pick("a", False), digits).alias("line"), F.least(pick("a", True), pick("b", True)).alias("lo"), F.greatest(pick("a", True), pick("b", True)).alias("hi"))
    return out.where("lo < hi")
