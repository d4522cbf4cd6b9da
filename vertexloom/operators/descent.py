"""Descent on stress with second-order steps: gradient, step size from the curvature along it, Runge-Kutta's four stages, and
projection onto constraints after each axis.

Stress is the sum over pairs of w (|x_i - x_j| - d)^2 / d^2 for ideal distances d. The curvature along a direction e needs no
matrix: each axis' Hessian has rows that add up to 0, so e'He is a sum over pairs of H_ij (e_i - e_j)^2, one grouped
aggregate over the same pairs that give the gradient. Both are sums over all pairs of a graph by their nature.

Ideal distances: graph_id, i, j, d for ordered pairs, and perhaps goal, the pair's weight: where it is above 1, the pair only
pushes (it counts with weight 1 while closer than d). Nodes at one place have no direction between them and don't
count as a pair. Fixed nodes stay; anchored ones (`anchors`: graph_id, idx, ax, ay) are drawn to their place as strongly as the
stiffest node is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.force import _ideal, raw_stress
from vertexloom.operators.ingest import check_canvas, check_iterations, in_range, with_ends
from vertexloom.operators.orthogonal import neighbours_along
from vertexloom.operators.projection import project
from vertexloom.operators.static_layouts import centred
from vertexloom.plans.lineage import Rounds, cut
from vertexloom.sources.graphs import Graph

#: Tables that a step may still read: a stage with projections writes at most 7.
KEEP = 40
#: Rounds of prices for a projection within a layout.
PRICED = 6
#: (nodes with wished places, axis) -> nodes with allowed ones.
Project = Callable[[DataFrame, str], DataFrame]


def ideal_distances(g: Graph, edge_length: float = 100.0, apart: float | None = None) -> DataFrame:
    """Hops times edge_length for all pairs; pairs that no edge joins have goal 2, so they only push."""
    joined = in_range(g).where("src <> dst").select("graph_id", "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("goal"))
    both = joined.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "goal").unionByName(joined.select("graph_id", F.col("dst").alias("i"), F.col("src").alias("j"), "goal"))
    goal = both.groupBy("graph_id", "i", "j").agg(F.max("goal").alias("goal"))
    every = _ideal(g, edge_length, apart).join(goal, ["graph_id", "i", "j"], "left")
    return every.withColumn("goal", F.coalesce("goal", F.lit(2.0)))


def _pairs(nodes: DataFrame, ideal: DataFrame, *carried: str) -> DataFrame:
    """graph_id, i, and for each pair dx, dy, pull (the gradient's factor), hx, hy (the Hessian's entries), and the carried
    columns of both ends as a_ and b_."""
    columns = ("x", "y", *carried)
    for end, name in (("i", "a"), ("j", "b")):
        ideal = ideal.join(nodes.select("graph_id", F.col("idx").alias(end), *(F.col(c).alias(f"{name}_{c}") for c in columns)), ["graph_id", end])
    goal = F.coalesce("goal", F.lit(1.0)) if "goal" in ideal.columns else F.lit(1.0)
    own = ideal.withColumn("dx", F.col("a_x") - F.col("b_x")).withColumn("dy", F.col("a_y") - F.col("b_y"))
    own = own.withColumn("l", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("goal", goal)
    own = own.where("l > 0 and d > 0 and d < double('inf') and not (goal > 1 and l > d)")
    weight, d, l = F.least("goal", F.lit(1.0)), F.col("d"), F.col("l")  # noqa: E741
    stiff = lambda c: -2 * weight / (d * d * l * l * l) * (2 * l * l * l + d * (F.col(c) * F.col(c) - l * l))
    return own.withColumn("pull", 2 * weight * (l - d) / (d * d * l)).withColumn("hx", stiff("dx")).withColumn("hy", stiff("dy"))


def gradient(nodes: DataFrame, ideal: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """nodes with gx, gy and held, the weight on the diagonal of an anchored node (0 for others)."""
    one = _pairs(nodes, ideal).groupBy("graph_id", F.col("i").alias("idx")).agg(
        F.sum(F.col("dx") * F.col("pull")).alias("gx"), F.sum(F.col("dy") * F.col("pull")).alias("gy"), F.sum(-F.col("hx")).alias("hx"), F.sum(-F.col("hy")).alias("hy")
    )
    own = nodes.join(one, ["graph_id", "idx"], "left")
    gx, gy, held = F.coalesce("gx", F.lit(0.0)), F.coalesce("gy", F.lit(0.0)), F.lit(0.0)
    if anchors is not None:
        most = one.groupBy("graph_id").agg(F.max(F.greatest(F.abs("hx"), F.abs("hy"))).alias("most"))
        own = own.join(most, "graph_id", "left").join(anchors.select("graph_id", "idx", "ax", "ay"), ["graph_id", "idx"], "left")
        held = F.when(F.col("ax").isNotNull(), F.coalesce("most", F.lit(0.0))).otherwise(0.0)
        gx, gy = (g - held * F.coalesce(F.col(a) - F.col(c), F.lit(0.0)) for g, a, c in ((gx, "ax", "x"), (gy, "ay", "y")))
    free = F.coalesce("fixed", F.lit(0)) == 0
    return own.select(*nodes.columns, F.when(free, gx).otherwise(0.0).alias("gx"), F.when(free, gy).otherwise(0.0).alias("gy"), held.alias("held"))


def step_size(graded: DataFrame, ideal: DataFrame, ex: str = "gx", ey: str = "gy") -> DataFrame:
    """graph_id, step: g'e / e'He, the best step along the direction (ex, ey) if the Hessian stays; 0 where e'He is 0."""
    a, b = ((F.col(f"a_{e}") - F.col(f"b_{e}")) for e in (ex, ey))
    bent = _pairs(graded, ideal, ex, ey).groupBy("graph_id").agg(F.sum(-0.5 * (F.col("hx") * a * a + F.col("hy") * b * b)).alias("bent"))
    along = F.col("gx") * F.col(ex) + F.col("gy") * F.col(ey)
    square = F.col(ex) * F.col(ex) + F.col(ey) * F.col(ey)
    own = graded.groupBy("graph_id").agg(F.sum(along).alias("along"), F.sum(F.col("held") * square).alias("held")).join(bent, "graph_id", "left")
    below = F.coalesce("bent", F.lit(0.0)) + F.col("held")
    return own.select("graph_id", F.when(below != 0, F.col("along") / below).otherwise(0.0).alias("step"))


def _stepped(nodes: DataFrame, step: DataFrame, ex: str, ey: str, projected: Project | None, keep: Rounds) -> DataFrame:
    """nodes moved by -step along (ex, ey), one axis after the other where there is a projection."""
    own = nodes.join(step, "graph_id")
    if projected is None:
        return _at(own, x=F.col("x") - F.col("step") * F.col(ex), y=F.col("y") - F.col("step") * F.col(ey)).drop("step")
    one = projected(keep(_at(own, x=F.col("x") - F.col("step") * F.col(ex))), "x")
    return projected(keep(_at(one, y=F.col("y") - F.col("step") * F.col(ey))), "y").drop("step")


def _at(nodes: DataFrame, **places: Column) -> DataFrame:
    return nodes.select(*(places[c].alias(c) if c in places else F.col(c) for c in nodes.columns))


def next_position(nodes: DataFrame, ideal: DataFrame, projected: Project | None = None, anchors: DataFrame | None = None, keep: Rounds | None = None) -> DataFrame:
    """nodes one step on. With a projection, the step goes to the allowed places, and then 0.2 to 1 times the way there, by
    the curvature along it, projected again."""
    keep = keep or Rounds(nodes.sparkSession, KEEP)
    graded = keep(gradient(nodes, ideal, anchors))
    moved = _stepped(graded, step_size(graded, ideal), "gx", "gy", projected, keep)
    if projected is not None:
        to = moved.select("graph_id", "idx", F.col("x").alias("__x"), F.col("y").alias("__y"))
        aimed = graded.join(to, ["graph_id", "idx"])
        aimed = keep(aimed.withColumn("__x", F.col("x") - F.col("__x")).withColumn("__y", F.col("y") - F.col("__y")))
        share = step_size(aimed, ideal, "__x", "__y").withColumn("step", F.greatest(F.lit(0.2), F.least("step", F.lit(1.0))))
        moved = _stepped(aimed, share, "__x", "__y", projected, keep)
    return keep(moved.select(nodes.columns))


def _mixed(nodes: DataFrame, *parts: tuple[float, DataFrame]) -> DataFrame:
    """nodes at the weighted sum of the parts' places."""
    every = None
    for weight, part in parts:
        own = part.select("graph_id", "idx", (weight * F.col("x")).alias("x"), (weight * F.col("y")).alias("y"))
        every = own if every is None else every.unionByName(own)
    places = every.groupBy("graph_id", "idx").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return nodes.drop("x", "y").join(places, ["graph_id", "idx"]).select(nodes.columns)


def runge_kutta(nodes: DataFrame, ideal: DataFrame, projected: Project | None = None, anchors: DataFrame | None = None, keep: Rounds | None = None) -> DataFrame:
    """One step of the four-stage method: the second and third stage start halfway to the stage before, the fourth at the third."""
    keep = keep or Rounds(nodes.sparkSession, KEEP)
    to = lambda start: next_position(start, ideal, projected, anchors, keep)
    half = lambda end: _mixed(nodes, (0.5, nodes), (0.5, end))
    a = to(nodes)
    b = to(half(a))
    c = to(half(b))
    d = to(c)
    return keep(_mixed(nodes, (1 / 6, a), (2 / 6, b), (2 / 6, c), (1 / 6, d)))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """graph_id, moved: the sum of squared movements."""
    a = before.select("graph_id", "idx", F.col("x").alias("ox"), F.col("y").alias("oy"))
    square = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return after.join(a, ["graph_id", "idx"]).groupBy("graph_id").agg(F.sum(square).alias("moved"))


def descend(nodes: DataFrame, ideal: DataFrame, iterations: int, projected: Project | None = None, anchors: DataFrame | None = None, threshold: float = 1e-4, stages: int = 4) -> DataFrame:
    """Steps until the squared movement of all graphs together changes by less than the threshold's share from one to the
    next. stages: 4 for Runge-Kutta, 1 for plain steps."""
    check_iterations(iterations)
    one = runge_kutta if stages == 4 else next_position
    keep = Rounds(nodes.sparkSession, KEEP)
    state, last = keep(nodes), float("inf")
    for _ in range(iterations):
        new = one(state, ideal, projected, anchors, keep)
        moved = displacement(state, new).agg(F.sum("moved")).first()[0] or 0.0
        state = new
        if moved == 0 or abs(last / moved - 1) < threshold:
            break
        last = moved
    return state


def stress(nodes: DataFrame, ideal: DataFrame) -> DataFrame:
    """graph_id, stress: the sum over pairs of ((|x_i - x_j| - d) / d)^2, each pair once, whatever its goal."""
    return raw_stress(nodes, ideal)


def constrained_layout(
    g: Graph, size=(1000.0, 1000.0), edge_length: float = 100.0, constraints: DataFrame | None = None, gap: float | None = None, unconstrained: int = 10, constrained: int = 10,
    apart: int = 10, centre: bool = True, anchors: DataFrame | None = None, stages: int = 1,
) -> DataFrame:
    """Nodes after three phases: free descent, then with the constraints (graph_id, axis, left, right, gap, equal), then also with
    boxes kept apart by `gap` (left out where gap is None). Constraints hold at the end if the last phase has a step."""
    check_canvas(size)
    g = g.settled()
    ideal = cut(ideal_distances(g, edge_length))
    state = descend(g.nodes, ideal, unconstrained, None, anchors, stages=stages)
    given = cut(constraints) if constraints is not None else None

    def of(axis: str) -> DataFrame | None:
        return None if given is None else given.where(F.col("axis") == axis).drop("axis")

    def user(nodes: DataFrame, axis: str) -> DataFrame:
        return project(nodes, of(axis), axis, 1e-3, rounds=PRICED, every=PRICED, nearest=False)

    def all_of_them(nodes: DataFrame, axis: str) -> DataFrame:
        # boxes that overlap across the axis are kept in the order they stand in along it
        near = neighbours_along(nodes, axis, gap)
        other, across = ("y", "height") if axis == "x" else ("x", "width")
        own = with_ends(near.withColumnsRenamed({"left": "src", "right": "dst"}), nodes, other, across, axis)
        overlap = (F.coalesce(f"a_{across}", F.lit(0.0)) + F.coalesce(f"b_{across}", F.lit(0.0))) / 2 - F.abs(F.col(f"a_{other}") - F.col(f"b_{other}"))
        missing = F.col("gap") - (F.col(f"b_{axis}") - F.col(f"a_{axis}"))
        # what is cheaper to part across is left to the other axis
        kept = own.where((missing <= 0) | (missing <= overlap) | F.lit(axis == "y")).select("graph_id", F.col("src").alias("left"), F.col("dst").alias("right"), "gap", F.lit(False).alias("equal"))
        every = kept if given is None else kept.unionByName(of(axis).select(kept.columns))
        return project(nodes, every, axis, 1e-3, rounds=PRICED, every=PRICED, nearest=False)

    if given is not None and constrained:
        state = descend(state, ideal, constrained, user, anchors, stages=stages)
    if gap is not None and apart:
        state = descend(state, ideal, apart, all_of_them, anchors, stages=stages)
    return centred(state, size) if centre else state
