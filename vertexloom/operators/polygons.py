"""Convex polygons: common tangents, overlap, and which tangents see past the others.

Corners are rows graph_id, polygon, pos, x, y, in order round each polygon (as `planar.convex_hull` gives them for points). A line
through a corner is a tangent there if both neighbouring corners lie strictly on one side of it, which for a convex polygon
says the same of all its corners; so pairs of corners of two polygons are tested by themselves, without a search. Polygons
of fewer than three corners have no sides and give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.functions.geometry import segments_meet, turn
from vertexloom.operators.metrics import _cells


def ringed(corners: DataFrame) -> DataFrame:
    """corners with their neighbours' places: px, py before and nx, ny after."""
    ring = W.Window.partitionBy("graph_id", "polygon").orderBy("pos")
    whole = ring.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    own = corners.select("graph_id", "polygon", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for c in ("x", "y"):
        own = own.withColumn(f"p{c}", F.coalesce(F.lag(c).over(ring), F.last(c).over(whole))).withColumn(f"n{c}", F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)))
    return own.withColumn("corners", F.count("*").over(whole)).where("corners > 2").drop("corners")


def tangents(corners: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """graph_id, a, b, a_pos, b_pos, ax, ay, bx, by, kind of the common tangents of polygons a < b of a graph, or of the given
    `pairs` (graph_id, a, b). kind: the sides (l or r of the way from a to b) on which a and b lie."""
    own = ringed(corners)
    a, b = (own.select("graph_id", F.col("polygon").alias(m), F.col("pos").alias(f"{m}_pos"), *(F.col(c).alias(f"{m}{c}") for c in ("x", "y", "px", "py", "nx", "ny"))) for m in ("a", "b"))
    both = a.join(b, "graph_id").where("a < b") if pairs is None else pairs.select("graph_id", "a", "b").distinct().join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"])
    line = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    side = lambda m, n: turn(*line, F.col(f"{m}{n}x"), F.col(f"{m}{n}y"))
    met = both.where((side("a", "p") == side("a", "n")) & (side("a", "p") != 0) & (side("b", "p") == side("b", "n")) & (side("b", "p") != 0))
    letter = lambda m: F.when(side(m, "p") > 0, "l").otherwise("r")
    return met.select("graph_id", "a", "b", "a_pos", "b_pos", *line, F.concat(letter("a"), letter("b")).alias("kind"))


def _lines(corners: DataFrame) -> DataFrame:
    """The polygons' sides in the form of edges from a polygon to itself."""
    own = ringed(corners)
    return own.select("graph_id", F.lit(1).alias("eid"), F.col("polygon").alias("src"), F.col("polygon").alias("dst"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("nx").alias("b_x"), F.col("ny").alias("b_y"))


def _met(lines: DataFrame) -> DataFrame:
    """Pairs p, q of lines (eid 0 and 1) in a cell of one grid that have a point in common."""
    celled = _cells(lines, 4096)
    p, q = celled.where("eid = 0").alias("p"), celled.where("eid = 1").alias("q")
    same = (F.col("p.graph_id") == F.col("q.graph_id")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))
    return p.join(q, same).where(segments_meet(*(F.col(f"{e}.{c}") for e in ("p", "q") for c in ("a_x", "a_y", "b_x", "b_y"))))


def visible(found: DataFrame, corners: DataFrame) -> DataFrame:
    """The tangents (as `tangents` gives them) that meet no third polygon's side."""
    own = found.select("graph_id", F.lit(0).alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("ax").alias("a_x"), F.col("ay").alias("a_y"), F.col("bx").alias("b_x"), F.col("by").alias("b_y"))
    hit = _met(own.unionByName(_lines(corners))).where("q.src <> p.src and q.src <> p.dst")
    hit = hit.select("p.graph_id", F.col("p.src").alias("a"), F.col("p.dst").alias("b"), F.col("p.a_x").alias("ax"), F.col("p.a_y").alias("ay"), F.col("p.b_x").alias("bx"), F.col("p.b_y").alias("by")).distinct()
    return found.join(hit, ["graph_id", "a", "b", "ax", "ay", "bx", "by"], "left_anti")


def overlaps(corners: DataFrame) -> DataFrame:
    """graph_id, a, b: polygons a < b that have a point in common: sides that meet, or one polygon's corner inside the other."""
    sides = _lines(corners)
    crossed = _met(sides.withColumn("eid", F.lit(0)).unionByName(sides)).where("p.src < q.src").select("p.graph_id", F.col("p.src").alias("a"), F.col("q.src").alias("b"))
    # without crossing sides a polygon lies in another with all corners or none: one corner tells
    own = ringed(corners)
    spot = own.groupBy("graph_id", "polygon").agg(F.min_by(F.struct("x", "y"), "pos").alias("s"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inner, outer = spot.select("graph_id", F.col("polygon").alias("i"), "s"), spot.select("graph_id", F.col("polygon").alias("o"), "x0", "x1", "y0", "y1")
    near = inner.join(outer, "graph_id").where("i <> o and s.x between x0 and x1 and s.y between y0 and y1").select("graph_id", "i", "o", "s")
    side = turn(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"), F.col("s.x"), F.col("s.y"))
    turns = near.join(own.withColumnRenamed("polygon", "o"), ["graph_id", "o"]).groupBy("graph_id", "i", "o").agg(F.min(side).alias("least"), F.max(side).alias("most"))
    held = turns.where("least >= 0 or most <= 0").select("graph_id", F.least("i", "o").alias("a"), F.greatest("i", "o").alias("b"))
    return crossed.unionByName(held).distinct()
