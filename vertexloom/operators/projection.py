"""The nearest places that meet separation and alignment constraints.

Constraints along one axis: graph_id, left, right, gap (left + gap <= right, or = where the column `equal` is true). Nodes
that are tied to each other by equalities move as one: `classes` gives each its place beside the class's least node. The others
are met by least movement, sum of weight * (place - wish)^2: every inequality has a price, and prices push its two ends apart.
An inequality belongs to its end with more of them, so that they make up stars. Each round all stars get in parallel the
prices that are best for them alone, with momentum, so that rounds don't grow with the size of a star; a star by itself
takes one. A round is a grouped sum over the constraints' ends, two joins on nodes and a sort of each star by its leaves,
so its work is that of the constraints; a star's leaves are sorted in one task. What misses its gap by less than `tolerance` at the end is pushed by longest paths, so that all gaps hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.ingest import ValidationError
from vertexloom.operators.orthogonal import separated
from vertexloom.operators.traversal import fixpoint
from vertexloom.plans.lineage import Rounds, cut

FIXED_WEIGHT = 1000.0
RESTART = 20  # rounds after which momentum starts anew


class ContradictionError(ValidationError):
    """Constraints that no placement meets."""


def alignments(members: DataFrame) -> DataFrame:
    """Equalities of alignment groups: members (graph_id, aid, idx, offset) all stand at their group's line plus offset. Each is
    tied to its group's least node, so an alignment of k nodes takes k - 1 rows."""
    first = members.groupBy("graph_id", "aid").agg(F.min(F.struct("idx", "offset")).alias("f"))
    tied = members.join(first, ["graph_id", "aid"]).where(F.col("idx") != F.col("f.idx"))
    gap = F.col("offset") - F.col("f.offset")
    return tied.select("graph_id", F.col("f.idx").alias("left"), F.col("idx").alias("right"), gap.cast("double").alias("gap"), F.lit(True).alias("equal"))


def classes(nodes: DataFrame, equalities: DataFrame) -> DataFrame:
    """graph_id, idx, root, offset: a node stands at its root's place plus offset; the root is the least node tied to it."""
    ties = equalities.select("graph_id", "left", "right", "gap")
    back = equalities.select("graph_id", F.col("right").alias("left"), F.col("left").alias("right"), (-F.col("gap")).alias("gap"))
    ties = cut(ties.unionByName(back))
    alone = nodes.select("graph_id", "idx", F.col("idx").alias("root"), F.lit(0.0).alias("offset"))
    if ties.isEmpty():
        return alone

    def step(state: DataFrame) -> DataFrame:
        moved = ties.join(state.withColumnRenamed("idx", "left"), ["graph_id", "left"])
        moved = moved.select("graph_id", F.col("right").alias("idx"), "root", (F.col("offset") + F.col("gap")).alias("offset"), F.lit(1).alias("new"))
        both = state.withColumn("new", F.lit(0)).unionByName(moved)
        best = both.groupBy("graph_id", "idx").agg(F.min(F.struct("root", "new", "offset")).alias("b"))
        return best.select("graph_id", "idx", "b.root", "b.offset")

    found = fixpoint(alone, step)
    a, b = (found.select("graph_id", F.col("idx").alias(end), F.col("offset").alias(f"__{end}")) for end in ("left", "right"))
    unmet = ties.join(a, ["graph_id", "left"]).join(b, ["graph_id", "right"]).where(F.abs(F.col("__left") + F.col("gap") - F.col("__right")) > 1e-6)
    if not unmet.isEmpty():
        raise ContradictionError("equalities contradict each other")
    return found


def _between_classes(constraints: DataFrame, tied: DataFrame) -> DataFrame:
    """graph_id, left, right (roots), gap: the strictest inequality for each pair of classes."""
    for end in ("left", "right"):
        own = tied.select("graph_id", F.col("idx").alias(end), F.col("root").alias(f"{end}_root"), F.col("offset").alias(f"{end}_offset"))
        constraints = constraints.join(own, ["graph_id", end])
    gap = F.col("gap") + F.col("left_offset") - F.col("right_offset")
    found = constraints.groupBy("graph_id", F.col("left_root").alias("left"), F.col("right_root").alias("right")).agg(F.max(gap).alias("gap"))
    return found


def project(nodes: DataFrame, constraints: DataFrame, axis: str, tolerance: float = 1e-4, rounds: int = 1000, every: int = 10, nearest: bool = True) -> DataFrame:
    """nodes with the axis moved as little as meets all constraints; nothing moves where all are met.

    Fixed nodes weigh 1000 times as much as others. Constraints whose ends aren't nodes are left out. Contradictions raise
    ContradictionError: of equalities and of gaps within a class at once, of others after `rounds`. Without `nearest`, prices
    are taken as they are after `rounds`, and longest paths do the rest.
    """
    if "equal" not in constraints.columns:
        constraints = constraints.withColumn("equal", F.lit(False))
    constraints = constraints.withColumn("equal", F.coalesce("equal", F.lit(False))).where("left <> right or gap > 0")
    known = nodes.select("graph_id", "idx")
    for end in ("left", "right"):
        constraints = constraints.join(known.withColumnRenamed("idx", end), ["graph_id", end], "left_semi")
    constraints = cut(constraints.select("graph_id", "left", "right", F.col("gap").cast("double").alias("gap"), "equal"))
    weight = F.when(F.coalesce("fixed", F.lit(0)) != 0, FIXED_WEIGHT).otherwise(1.0) if "fixed" in nodes.columns else F.lit(1.0)
    tied = classes(nodes, constraints.where("equal"))
    own = nodes.select("graph_id", "idx", F.col(axis).alias("p"), weight.alias("weight")).join(tied, ["graph_id", "idx"])
    wished = own.groupBy("graph_id", F.col("root").alias("idx")).agg(
        (F.sum(F.col("weight") * (F.col("p") - F.col("offset"))) / F.sum("weight")).alias("wish"), F.sum("weight").alias("weight")
    )
    wished = cut(wished)
    rows = cut(_between_classes(constraints.where("not equal"), tied))
    if not rows.where("left = right and gap > 1e-9").isEmpty():
        raise ContradictionError("a gap within an alignment can't be met")
    rows = rows.where("left <> right")
    placed = wished.select("graph_id", "idx", F.col("wish").alias("p"))
    if not _missed(rows, placed, tolerance).isEmpty():
        placed = separated(_priced(rows, wished, tolerance, rounds, every, nearest), rows, "p")
    moved = tied.join(placed.withColumnRenamed("idx", "root"), ["graph_id", "root"]).select("graph_id", "idx", (F.col("p") + F.col("offset")).alias(axis))
    return nodes.drop(axis).join(moved, ["graph_id", "idx"]).select(nodes.columns)


def _ends(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows with pl and pr, the places of their ends."""
    for end, name in (("left", "pl"), ("right", "pr")):
        rows = rows.join(placed.select("graph_id", F.col("idx").alias(end), F.col("p").alias(name)), ["graph_id", end])
    return rows


def _missed(rows: DataFrame, placed: DataFrame, tolerance: float) -> DataFrame:
    return _ends(rows, placed).where(F.col("pl") + F.col("gap") - F.col("pr") > tolerance)


def _starred(rows: DataFrame, wished: DataFrame) -> DataFrame:
    """rows with hub (their end with more rows; of equal ones the lesser idx), leaf, out (whether the hub is their left end),
    and hub_weight, leaf_weight: the ends' weights, divided among the stars that a node is in."""
    both = rows.select("graph_id", F.col("left").alias("idx")).unionByName(rows.select("graph_id", F.col("right").alias("idx")))
    count = both.groupBy("graph_id", "idx").agg(F.count("*").alias("p"))
    more = F.struct("pl", (-F.col("left")).alias("idx")) > F.struct(F.col("pr").alias("pl"), (-F.col("right")).alias("idx"))
    dealt = _ends(rows, count).withColumn("out", more).withColumn("hub", F.when(more, F.col("left")).otherwise(F.col("right"))).withColumn("leaf", F.when(more, F.col("right")).otherwise(F.col("left")))
    dealt = cut(dealt.drop("pl", "pr"))
    # a hub is in its own star and, as a leaf, in one for each further row
    shares = dealt.select("graph_id", F.col("leaf").alias("idx"), F.lit(1).alias("n")).unionByName(dealt.select("graph_id", F.col("hub").alias("idx"), F.lit(1).alias("n")).distinct())
    share = shares.groupBy("graph_id", "idx").agg(F.sum("n").alias("n")).join(wished, ["graph_id", "idx"]).select("graph_id", "idx", (F.col("weight") / F.col("n")).alias("w"))
    for end in ("hub", "leaf"):
        dealt = dealt.join(share.select("graph_id", F.col("idx").alias(end), F.col("w").alias(f"{end}_weight")), ["graph_id", end])
    return dealt


def _answered(met: DataFrame) -> DataFrame:
    """met (rows of stars with the prices `asked` and places pl, pr under all of these) with the prices that are best for each star
    alone, the other stars' prices staying: the hub's place is where its pull and those of the leaves it reaches are even, which
    sums over the leaves in order of where the hub reaches them tell."""
    star = W.Window.partitionBy("graph_id", "hub")
    pushed = F.when(F.col("out"), F.col("asked")).otherwise(-F.col("asked"))  # on the leaf
    hub_at, leaf_at = F.when(F.col("out"), F.col("pl")).otherwise(F.col("pr")), F.when(F.col("out"), F.col("pr")).otherwise(F.col("pl"))
    alone = leaf_at - pushed / F.col("leaf_weight")
    met = met.withColumn("at", alone + F.when(F.col("out"), -F.col("gap")).otherwise(F.col("gap"))).withColumn("hub_at", hub_at + F.sum(pushed).over(star) / F.col("hub_weight"))
    order = star.orderBy("at", "leaf", "out").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    right, left = (F.when(side, F.col("leaf_weight")).otherwise(0.0) for side in (F.col("out"), ~F.col("out")))
    mass = F.col("hub_weight") + F.sum(right).over(order) + (F.sum(left).over(star) - F.sum(left).over(order))
    pull = F.col("hub_weight") * F.col("hub_at") + F.sum(right * F.col("at")).over(order) + (F.sum(left * F.col("at")).over(star) - F.sum(left * F.col("at")).over(order))
    met = met.withColumn("mass", mass).withColumn("pull", pull)
    # the last leaf that the hub's place isn't before; before all leaves only those to the left pull
    last = F.max(F.when(F.col("at") * F.col("mass") <= F.col("pull"), F.struct("at", "leaf", "out", "mass", "pull"))).over(star)
    none = F.struct((F.col("hub_weight") + F.sum(left).over(star)).alias("mass"), (F.col("hub_weight") * F.col("hub_at") + F.sum(left * F.col("at")).over(star)).alias("pull"))
    met = met.withColumn("last", last).withColumn("none", none)
    place = F.coalesce(F.col("last.pull") / F.col("last.mass"), F.col("none.pull") / F.col("none.mass"))
    reached = F.when(F.col("out"), place - F.col("at")).otherwise(F.col("at") - place)
    return met.withColumn("answer", F.greatest(F.lit(0.0), F.col("leaf_weight") * reached))


def _priced(rows: DataFrame, wished: DataFrame, tolerance: float, rounds: int, every: int, nearest: bool) -> DataFrame:
    """graph_id, idx, p: places under the prices at which no gap is missed by more than the tolerance."""
    own = ("graph_id", "left", "right", "gap", "hub", "leaf", "out", "hub_weight", "leaf_weight")
    keep = Rounds(rows.sparkSession)
    state = keep(_starred(rows, wished).select(*own, F.lit(0.0).alias("price"), F.lit(0.0).alias("old")))

    def places(state: DataFrame, ahead: float) -> DataFrame:
        price = F.col("price") + ahead * (F.col("price") - F.col("old"))
        pushed = state.select("graph_id", F.explode(F.array(F.struct(F.col("left").alias("idx"), (-price).alias("f")), F.struct(F.col("right").alias("idx"), price.alias("f")))).alias("e"))
        force = pushed.groupBy("graph_id", F.col("e.idx").alias("idx")).agg(F.sum("e.f").alias("f"))
        return wished.join(force, ["graph_id", "idx"], "left").select("graph_id", "idx", (F.col("wish") + F.coalesce("f", F.lit(0.0)) / F.col("weight")).alias("p"))

    for n in range(1, rounds + 1):
        k = (n - 1) % RESTART
        ahead = k / (k + 3)
        met = _ends(state, places(state, ahead)).withColumn("asked", F.col("price") + ahead * (F.col("price") - F.col("old")))
        state = keep(_answered(met).select(*own, F.col("answer").alias("price"), F.col("price").alias("old")))
        if n == 1 or n % every == 0:
            placed = places(state, 0.0)
            # settled: no gap is missed, and none that has a price is open
            missed = F.col("pl") + F.col("gap") - F.col("pr")
            slack = _ends(state, placed).withColumn("missed", missed)
            worst = slack.agg(F.max(F.greatest(F.col("missed"), F.when(F.col("price") > tolerance, F.abs("missed")).otherwise(0.0)))).first()[0]
            if worst is None or worst <= tolerance:
                return placed
    if not nearest:
        return places(state, 0.0)
    raise ContradictionError(f"gaps are still missed after {rounds} rounds; they may contradict each other")
