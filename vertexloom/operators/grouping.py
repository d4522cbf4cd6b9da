"""Groups of nodes as boxes that hold their members and keep apart.

Groups are rows graph_id, gid, leaves (array of idx), children (array of gid); nodes in no group and groups in no
other lie side by side in the drawing itself. A group has two places along an axis, its sides, beside those of the nodes;
what holds among them are constraints of `projection`: sides round their members, and members of one container apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.orthogonal import neighbours_along
from vertexloom.operators.planar import group_bounds
from vertexloom.operators.projection import project
from vertexloom.plans.lineage import cut

TOP = -1  # the drawing as a container


def sides(gid: Column) -> tuple[Column, Column]:
    """Numbers of a group's sides among the nodes: below 0."""
    return -2 * gid - 1, -2 * gid - 2


def _members(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """graph_id, container, item, is_group: what lies in which container."""
    inside = lambda c, flag: groups.select("graph_id", F.col("gid").alias("container"), F.explode(c).alias("item"), F.lit(flag).alias("is_group"))
    held = inside("leaves", False).unionByName(inside("children", True))
    every = nodes.select("graph_id", F.col("idx").alias("item"), F.lit(False).alias("is_group")).unionByName(groups.select("graph_id", F.col("gid").alias("item"), F.lit(True).alias("is_group")))
    outer = every.join(held, ["graph_id", "item", "is_group"], "left_anti").select("graph_id", F.lit(TOP).cast("long").alias("container"), "item", "is_group")
    return held.unionByName(outer)


def group_constraints(nodes: DataFrame, groups: DataFrame, axis: str, padding: float = 10.0, gap: float = 0.0, cheaper_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes and the groups' sides, constraints along the axis among them). Items of a container that overlap across the axis are
    kept in the order of their centres; with cheaper_only, those that are parted with less movement across are left out."""
    size, other, across = ("width", "y", "height") if axis == "x" else ("height", "x", "width")
    members = cut(_members(nodes, groups))
    bounds = cut(group_bounds(nodes, groups, padding))
    half = F.coalesce(size, F.lit(0.0)) / 2
    item = nodes.select("graph_id", F.col("idx").alias("item"), F.lit(False).alias("is_group"), F.col("idx").alias("low"), F.col("idx").alias("high"), half.alias("half"), "x", "y", "width", "height")
    low, high = sides(F.col("gid"))
    box = bounds.select(
        "graph_id", F.col("gid").alias("item"), F.lit(True).alias("is_group"), low.alias("low"), high.alias("high"), F.lit(0.0).alias("half"),
        ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"),
    )
    own = cut(members.join(item.unionByName(box), ["graph_id", "item", "is_group"]))
    held = own.where(F.col("container") != TOP)
    first, last = sides(F.col("container"))
    rule = lambda left, right, need: held.select("graph_id", left.alias("left"), right.alias("right"), need.alias("gap"))
    need = padding + F.col("half")
    rules = rule(first, F.col("low"), need).unionByName(rule(F.col("high"), last, need))

    # a container's items as a graph of its own; a group's two places stand for its box
    key = F.concat_ws(" ", F.col("container").cast("string"), "graph_id")
    numbered = own.select("graph_id", key.alias("key"), F.when(F.col("is_group"), F.col("low")).otherwise(F.col("item")).alias("idx"), "low", "high", "half", "x", "y", "width", "height")
    near = neighbours_along(numbered.select(F.col("key").alias("graph_id"), "idx", "x", "y", "width", "height"), axis, gap).withColumnRenamed("graph_id", "key")
    for end in ("left", "right"):
        near = near.join(numbered.select("key", F.col("idx").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("low", "high", "half", axis, other, across))), ["key", end])
    near = near.join(numbered.select("key", "graph_id").distinct(), "key")
    if cheaper_only:
        missing = F.col("gap") - (F.col(f"right_{axis}") - F.col(f"left_{axis}"))
        overlap = (F.coalesce(f"left_{across}", F.lit(0.0)) + F.coalesce(f"right_{across}", F.lit(0.0))) / 2 - F.abs(F.col(f"left_{other}") - F.col(f"right_{other}"))
        near = near.where((missing <= 0) | (missing <= overlap))
    apart = near.select("graph_id", F.col("left_high").alias("left"), F.col("right_low").alias("right"), (F.col("left_half") + F.col("right_half") + gap).alias("gap"))
    spots = bounds.select("graph_id", F.explode(F.array(F.struct(low.alias("idx"), F.col(f"{axis}0").alias(axis)), F.struct(high.alias("idx"), F.col(f"{axis}1").alias(axis)))).alias("s")).select("graph_id", "s.idx", f"s.{axis}")
    every = nodes.select("graph_id", "idx", axis, *(["fixed"] if "fixed" in nodes.columns else [])).unionByName(spots, allowMissingColumns=True)
    return every, rules.unionByName(apart)


def with_groups_apart(nodes: DataFrame, groups: DataFrame, padding: float = 10.0, gap: float = 0.0, rounds: int = 10) -> DataFrame:
    """nodes moved, along x and then along y, so that every group's box holds its members with the padding and overlaps no other
    item of its container. Prices get `rounds` rounds, longest paths do the rest."""
    state = cut(nodes)
    for axis in ("x", "y"):
        every, rules = group_constraints(state, groups, axis, padding, gap, cheaper_only=axis == "x")
        placed = project(cut(every), rules, axis, 1e-6, rounds, rounds, nearest=False).select("graph_id", "idx", F.col(axis).alias("__p"))
        moved = state.join(placed, ["graph_id", "idx"])
        state = cut(moved.withColumn(axis, F.col("__p")).select(nodes.columns))
    return state
