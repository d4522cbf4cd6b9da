"""Axis-parallel routes round boxes: what a route hits, shortest paths with a price on bends, loops, and lanes written back.

Boxes are nodes with centres x, y and width, height; routes are rows graph_id, eid, points (array of x, y) as
`orthogonal.routes` makes them. A route may run along a box grown by `margin`, not inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.ingest import in_range
from vertexloom.operators.orthogonal import port_points, ports, routes
from vertexloom.operators.planar import lanes, route_segments
from vertexloom.plans.lineage import Rounds, cut
from vertexloom.sources.graphs import Graph

POINTS = "array<struct<x:double,y:double>>"


def boxes(nodes: DataFrame, margin: float = 0.0) -> DataFrame:
    """graph_id, idx, x0, y0, x1, y1 of nodes as boxes grown by the margin; nodes without a place have none."""
    half = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / 2 + margin
    own = nodes.where("x is not null and y is not null")
    return own.select("graph_id", "idx", *((F.col(c) + s * half(o)).alias(f"{c}{n}") for n, s in ((0, -1), (1, 1)) for c, o in (("x", "width"), ("y", "height"))))


def _cells(lo: Column, hi: Column, cell: Column) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def route_hits(routed: DataFrame, g: Graph, margin: float = 0.0) -> DataFrame:
    """graph_id, eid, seg, idx: the boxes, grown by the margin, through whose inside a route's segment runs; not those of its ends.

    Segments and boxes meet in square cells of the boxes' mean extent; a pair counts in the first cell both share.
    """
    grown = boxes(g.nodes, margin)
    cell = grown.groupBy("graph_id").agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")), F.lit(1e-9)).alias("cell"))
    held = grown.join(cell, "graph_id").withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("cell")))).withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), F.col("cell"))))
    x0, x1 = F.when(F.col("level"), F.col("lo")).otherwise(F.col("line")), F.when(F.col("level"), F.col("hi")).otherwise(F.col("line"))
    y0, y1 = F.when(F.col("level"), F.col("line")).otherwise(F.col("lo")), F.when(F.col("level"), F.col("line")).otherwise(F.col("hi"))
    runs = route_segments(routed).join(cell, "graph_id").select("graph_id", "eid", "seg", "cell", x0.alias("sx0"), y0.alias("sy0"), x1.alias("sx1"), y1.alias("sy1"))
    runs = runs.withColumn("cx", F.explode(_cells(F.col("sx0"), F.col("sx1"), F.col("cell")))).withColumn("cy", F.explode(_cells(F.col("sy0"), F.col("sy1"), F.col("cell")))).drop("cell")
    met = runs.join(held, ["graph_id", "cx", "cy"]).where("sx0 < x1 and x0 < sx1 and sy0 < y1 and y0 < sy1")
    first = (F.col("cx") == F.greatest(F.floor(F.col("sx0") / F.col("cell")), F.floor(F.col("x0") / F.col("cell")))) & (F.col("cy") == F.greatest(F.floor(F.col("sy0") / F.col("cell")), F.floor(F.col("y0") / F.col("cell"))))
    ends = in_range(g).select("graph_id", "eid", "src", "dst")
    return met.where(first).join(ends, ["graph_id", "eid"]).where("idx <> src and idx <> dst").select("graph_id", "eid", "seg", "idx")


def _outward(side: Column, amount: float) -> tuple[Column, Column]:
    return F.when(side == "e", amount).when(side == "w", -amount).otherwise(0.0), F.when(side == "s", amount).when(side == "n", -amount).otherwise(0.0)


def _stubs(g: Graph, margin: float) -> DataFrame:
    """graph_id, eid, end, port (x, y), x, y (the point `margin` outside the port), level: whether its side is left along x."""
    points = port_points(g, ports(g))
    dx, dy = _outward(F.col("side"), margin)
    return points.select("graph_id", "eid", "end", F.struct("x", "y").alias("port"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("side").isin("e", "w").alias("level"))


def free_lines(spots: DataFrame, grown: DataFrame) -> DataFrame:
    """graph_id, level, line, lo, hi: the longest stretches along x and y through the spots that enter no grown box; spots
    inside a box give none. Spots meet boxes in strips of the mean extent across."""
    found = None
    around = grown.groupBy("graph_id").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"), F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")), F.lit(1e-9)).alias("strip"))
    for level, along, across in ((True, "x", "y"), (False, "y", "x")):
        own = spots.select("graph_id", F.col(across).alias("line"), F.col(along).alias("at")).distinct().join(around, "graph_id")
        own = own.withColumn("cell", F.floor(F.col("line") / F.col("strip")))
        held = grown.join(around.select("graph_id", "strip"), "graph_id").withColumn("cell", F.explode(_cells(F.col(f"{across}0"), F.col(f"{across}1"), F.col("strip"))))
        held = held.select("graph_id", "cell", F.col(f"{along}0").alias("a0"), F.col(f"{along}1").alias("a1"), F.col(f"{across}0").alias("c0"), F.col(f"{across}1").alias("c1"))
        near = (F.col("line") > F.col("c0")) & (F.col("line") < F.col("c1"))
        met = own.join(held, ["graph_id", "cell"], "left")
        free = met.groupBy("graph_id", "line", "at", *(f"b{along}{i}" for i in (0, 1))).agg(
            F.max(F.when(near & (F.col("a1") <= F.col("at")), F.col("a1"))).alias("lo"), F.min(F.when(near & (F.col("a0") >= F.col("at")), F.col("a0"))).alias("hi"),
            F.coalesce(F.max(near & (F.col("a0") < F.col("at")) & (F.col("a1") > F.col("at"))), F.lit(False)).alias("inside"),
        )
        edge = lambda c, b, f: F.coalesce(F.col(c), f(F.col(b), F.col("at")))
        one = free.where("not inside").select("graph_id", F.lit(level).alias("level"), "line", edge("lo", f"b{along}0", F.least).alias("lo"), edge("hi", f"b{along}1", F.greatest).alias("hi")).distinct()
        found = one if found is None else found.unionByName(one)
    return found


def route_grid(lines: DataFrame) -> DataFrame:
    """graph_id, x, y, h, v: where a free line along x crosses one along y; h and v are the lines' lower ends, so that points
    with one y and h, or one x and v, see each other. Lines meet in strips of the mean line length."""
    level, upright = lines.where("level"), lines.where("not level")
    strip = level.groupBy("graph_id").agg(F.greatest(F.avg(F.col("hi") - F.col("lo")), F.lit(1e-9)).alias("strip"))
    a = level.join(strip, "graph_id").select("graph_id", F.col("line").alias("y"), F.col("lo").alias("h"), F.col("hi").alias("h1"), F.explode(_cells(F.col("lo"), F.col("hi"), F.col("strip"))).alias("cell"))
    b = upright.join(strip, "graph_id").select("graph_id", F.col("line").alias("x"), F.col("lo").alias("v"), F.col("hi").alias("v1"), F.floor(F.col("line") / F.col("strip")).alias("cell"))
    return a.join(b, ["graph_id", "cell"]).where("x >= h and x <= h1 and y >= v and y <= v1").select("graph_id", "x", "y", "h", "v")


def grid_routes(g: Graph, margin: float = 10.0, bend: float = 50.0, wanted: DataFrame | None = None, slack: float = 1.5, max_rounds: int = 60) -> DataFrame:
    """graph_id, eid, cost, points: for each edge (of `wanted`: graph_id, eid) the path from port to port of least length plus
    `bend` for each bend that enters no box grown by the margin; ties to fewer bends, then the least points.

    Paths run on free lines through the grown boxes' corners and the ports' stubs, among which there is always a cheapest one.
    A search state is a point and the axis it was reached along; one round turns and goes on to every point in sight, so
    rounds are as many as bends. A search leaves out what can't end within `slack` times the straight way and four bends; if
    nothing ends there, that limit doubles, until it holds all the grid. Edges whose stub lies in another grown box, and
    loops, have no row.
    """
    grown = cut(boxes(g.nodes, margin))
    stubs = _stubs(g, margin)
    stubs = cut(stubs if wanted is None else stubs.join(wanted.select("graph_id", "eid"), ["graph_id", "eid"], "left_semi"))
    corners = grown.select("graph_id", F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")))).alias("p")).select("graph_id", "p.x", "p.y")
    grid = cut(route_grid(free_lines(corners.unionByName(stubs.select("graph_id", "x", "y")), grown)))
    a, b = (stubs.where(F.col("end") == e).select("graph_id", "eid", *(F.col(c).alias(f"{m}_{c}") for c in ("port", "x", "y", "level"))) for e, m in (("src", "a"), ("dst", "b")))
    asked = a.join(b, ["graph_id", "eid"])
    straight = F.abs(F.col("a_x") - F.col("b_x")) + F.abs(F.col("a_y") - F.col("b_y"))
    whole = grown.groupBy("graph_id").agg((2 * (F.max("x1") - F.min("x0") + F.max("y1") - F.min("y0"))).alias("whole"), F.count("*").alias("n"))
    at = grid.select("graph_id", "x", "y").distinct()
    for m in ("a", "b"):
        asked = asked.join(at.withColumnsRenamed({"x": f"{m}_x", "y": f"{m}_y"}), ["graph_id", f"{m}_x", f"{m}_y"], "left_semi")
    asked = cut(asked.join(whole, "graph_id").withColumn("limit", slack * straight + 4 * bend).withColumn("most", F.col("n") * (F.col("whole") + 4 * bend)).drop("whole", "n"))
    done, keep = None, Rounds(g.nodes.sparkSession)
    while True:
        found = cut(_searched(asked, grid, bend, keep, max_rounds))
        done = found if done is None else done.unionByName(found)
        asked = cut(asked.join(found.select("graph_id", "eid"), ["graph_id", "eid"], "left_anti").where("limit < most").withColumn("limit", F.col("limit") * 2))
        if asked.isEmpty():
            break
    ends = [F.array(F.struct(F.col("port.x").alias("x"), F.col("port.y").alias("y")))]
    out = done.join(a.select("graph_id", "eid", F.col("a_port").alias("port")), ["graph_id", "eid"]).withColumn("points", F.concat(*ends, "path")).drop("port")
    out = out.join(b.select("graph_id", "eid", F.col("b_port").alias("port")), ["graph_id", "eid"]).withColumn("points", F.concat("points", *ends))
    return out.select("graph_id", "eid", (F.col("cost") + 2 * margin).alias("cost"), straightened(F.col("points")).alias("points"))


def straightened(points: Column) -> Column:
    """points without repeats and without those between two others on one axis-parallel line."""
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    line = lambda a, b, c: ((a["x"] == b["x"]) & (b["x"] == c["x"])) | ((a["y"] == b["y"]) & (b["y"] == c["y"]))

    def add(out: Column, p: Column) -> Column:
        n = F.size(out)
        last, before = F.get(out, n - 1), F.get(out, n - 2)
        return F.when((n > 0) & same(last, p), out).when((n > 1) & line(before, last, p), F.concat(F.slice(out, 1, n - 1), F.array(p))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(points, F.array().cast(POINTS), add)


def _searched(asked: DataFrame, grid: DataFrame, bend: float, keep: Rounds, max_rounds: int) -> DataFrame:
    """graph_id, eid, cost, path (the stubs' ends included) for the asked edges that have a way within their limit."""
    here = F.struct("x", "y")
    goal = asked.select("graph_id", "eid", "b_x", "b_y", "b_level", "limit")
    state = asked.select(
        "graph_id", "eid", F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("a_level").alias("level"), F.lit(0.0).alias("cost"),
        F.array(F.struct(F.col("a_x").alias("x"), F.col("a_y").alias("y"))).alias("path"), F.lit(True).alias("fresh"),
    )
    start = state.join(grid.select("graph_id", "x", "y").distinct(), ["graph_id", "x", "y"], "left_semi")

    def along(state: DataFrame, turn: bool) -> DataFrame:
        """States one straight run on from the fresh ones, after a turn or (from the stubs) without one."""
        from_points = state.where("fresh").join(grid, ["graph_id", "x", "y"])
        out = None
        for level, same, lower, moving in ((True, "y", "h", "x"), (False, "x", "v", "y")):
            fresh = from_points.where(F.col("level") == F.lit(level != turn)).select("graph_id", "eid", same, lower, F.col(moving).alias("from"), "cost", "path")
            to = fresh.join(grid.select("graph_id", same, lower, F.col(moving).alias("to")), ["graph_id", same, lower]).where("to <> from")
            price = F.col("cost") + F.abs(F.col("to") - F.col("from")) + (bend if turn else 0.0)
            one = to.select("graph_id", "eid", F.col("to").alias(moving), same, F.lit(level).alias("level"), price.alias("cost"), "path")
            one = one.withColumn("path", F.concat("path", F.array(here)))
            out = one if out is None else out.unionByName(one)
        ahead = F.abs(F.col("x") - F.col("b_x")) + F.abs(F.col("y") - F.col("b_y"))
        return out.join(goal, ["graph_id", "eid"]).where(F.col("cost") + ahead <= F.col("limit")).select("graph_id", "eid", "x", "y", "level", "cost", "path")

    def best(state: DataFrame, new: DataFrame) -> DataFrame:
        both = state.withColumn("new", F.lit(0)).drop("fresh").unionByName(new.withColumn("new", F.lit(1)))
        least = both.groupBy("graph_id", "eid", "x", "y", "level").agg(F.min(F.struct("cost", F.size("path").alias("n"), "new", "path")).alias("b"))
        return least.select("graph_id", "eid", "x", "y", "level", "b.cost", "b.path", (F.col("b.new") == 1).alias("fresh"))

    state = keep(start)
    state = keep(best(state, along(state, False)).withColumn("fresh", F.lit(True)))
    for _ in range(max_rounds):
        state = keep(best(state, along(state, True)))
        reached = state.join(goal, ["graph_id", "eid"]).where("x = b_x and y = b_y")
        total = F.col("cost") + F.when(F.col("level") == F.col("b_level"), 0.0).otherwise(bend)
        ended = reached.groupBy("graph_id", "eid").agg(F.min(F.struct(total.alias("cost"), F.size("path").alias("n"), "path")).alias("b"))
        # a search goes on only from states that may still beat the best end
        left = state.where("fresh").join(ended, ["graph_id", "eid"], "left").where("b is null or cost < b.cost")
        if left.isEmpty():
            break
    return ended.select("graph_id", "eid", "b.cost", "b.path")


def self_loops(g: Graph, gap: float = 10.0) -> DataFrame:
    """graph_id, eid, points of edges from a node to itself: out at the top, round the right upper corner, in at the right side; a
    node's loops are `gap` apart, in order of eid."""
    rank = F.row_number().over(W.Window.partitionBy("graph_id", "src").orderBy("eid"))
    many = F.count("*").over(W.Window.partitionBy("graph_id", "src"))
    own = in_range(g).where("src = dst").select("graph_id", "eid", F.col("src").alias("idx"), rank.alias("k"), (F.lit(0.5) * rank / (many + 1)).alias("share"))
    own = own.join(g.nodes.select("graph_id", "idx", "x", "y", F.coalesce("width", F.lit(0.0)).alias("w"), F.coalesce("height", F.lit(0.0)).alias("h")), ["graph_id", "idx"])
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    right, top, away = F.col("x") + F.col("w") / 2, F.col("y") - F.col("h") / 2, gap * F.col("k")
    x, y = right - F.col("share") * F.col("w"), top + F.col("share") * F.col("h")
    return own.select("graph_id", "eid", F.array(p(x, top), p(x, top - away), p(right + away, top - away), p(right + away, y), p(right, y)).alias("points"))


def routes_around(g: Graph, margin: float = 10.0, bend: float = 50.0) -> DataFrame:
    """graph_id, eid, points: plain routes where they hit no box, detours by `grid_routes` where they do, loops at their node."""
    g = g.settled()
    plain = cut(routes(g))
    bad = cut(route_hits(plain, g).select("graph_id", "eid").distinct())
    turned = grid_routes(g, margin, bend, bad).select("graph_id", "eid", "points")
    kept = plain.join(turned.select("graph_id", "eid"), ["graph_id", "eid"], "left_anti")
    return kept.unionByName(turned).unionByName(self_loops(g, margin))


def nudged(routed: DataFrame, gap: float = 8.0, rounds: int = 10) -> DataFrame:
    """graph_id, eid, points: routes whose overlapping segments are set side by side, with bends and ends moved along. Where that
    makes others overlap, they are set apart again by 0.6 of the gap before, until none overlap or `rounds` are over."""
    keep = Rounds(routed.sparkSession)
    state = keep(routed.select("graph_id", "eid", "points"))
    for _ in range(rounds):
        moved = lanes(route_segments(state), gap).where("offset <> 0")
        if moved.isEmpty():
            break
        shifts = moved.groupBy("graph_id", "eid").agg(F.map_from_entries(F.collect_list(F.struct("seg", "offset"))).alias("by"))
        shift = lambda k: F.coalesce(F.element_at("by", k), F.lit(0.0))

        def place(p: Column, i: Column) -> Column:
            before, after = F.get("points", i - 1), F.get("points", i + 1)
            x, y = F.lit(0.0), F.lit(0.0)
            for other, seg in ((before, i - 1), (after, i)):
                level = other["y"] == p["y"]
                y = y + F.when(other.isNotNull() & level, shift(seg)).otherwise(0.0)
                x = x + F.when(other.isNotNull() & ~level, shift(seg)).otherwise(0.0)
            return F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y"))

        both = state.join(shifts, ["graph_id", "eid"], "left")
        state = keep(both.select("graph_id", "eid", F.when(F.col("by").isNull(), F.col("points")).otherwise(F.transform("points", place)).alias("points")))
        gap *= 0.6
    return state
