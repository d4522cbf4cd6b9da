"""Force and stress layouts: one tick is a query over the node table, a run is a loop of ticks.

All-pairs forces are sums over a self-join of a graph's nodes; `leaf` replaces what lies far off by cells of a pyramid
(`spatial.interaction_forces`), so that a tick on a large graph costs nodes times levels instead of n * n. A run cuts lineage after each
tick through the shared folder (a tick reads its state several times) and every `every` ticks takes a one-row
aggregate that may stop it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import small_graphs
from vertexloom.operators.ingest import check_canvas, check_iterations, degrees, sizes, with_ends
from vertexloom.operators.spatial import LEAF, interaction_forces
from vertexloom.operators.static_layouts import centred
from vertexloom.operators.traversal import all_pairs
from vertexloom.plans.lineage import Rounds, cut, passing
from vertexloom.sources.graphs import Graph


IN_TASK = 1000  # nodes of a graph that a task takes whole


@dataclass
class Progress:
    """What a listener gets: start, tick or end, the tick's number and its movement."""

    kind: str
    tick: int
    movement: float


def _free() -> Column:
    return F.coalesce("fixed", F.lit(0)) == 0


def pair_forces(nodes: DataFrame, size: Callable[[Column], Column], charge: str | None = None, skip: float = 0.0) -> DataFrame:
    """graph_id, idx, fx, fy: the sum over all others of charge_i * charge_j * size(distance) along the line from them."""
    c = [F.col(charge).alias("__q")] if charge else [F.lit(1.0).alias("__q")]
    a = nodes.select("graph_id", "idx", "x", "y", *c).alias("a")
    b = nodes.select("graph_id", "idx", "x", "y", *c).alias("b")
    both = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.idx") != F.col("b.idx")))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    d = F.sqrt(dx * dx + dy * dy)
    one = both.select(F.col("a.graph_id").alias("graph_id"), F.col("a.idx").alias("idx"), dx.alias("dx"), dy.alias("dy"), d.alias("d"), (F.col("a.__q") * F.col("b.__q")).alias("q")).where(F.col("d") > skip)
    f = F.col("q") * size(F.col("d")) / F.col("d")
    return one.groupBy("graph_id", "idx").agg(F.sum(F.col("dx") * f).alias("fx"), F.sum(F.col("dy") * f).alias("fy"))


def all_forces(nodes: DataFrame, power: float, strength: float, charge: str | None = None, skip: float = 0.0, leaf: int = 0) -> DataFrame:
    """pair_forces of strength / distance^power, by interaction lists of cells with `leaf` bodies where leaf isn't 0."""
    if leaf:
        return interaction_forces(nodes, power, strength, charge, leaf, skip)
    return pair_forces(nodes, lambda d: strength / F.pow(d, F.lit(power)) if power != 1 else strength / d, charge, skip)


def edge_forces(g: Graph, nodes: DataFrame, size: Callable[[Column], Column], skip: float = 0.0) -> DataFrame:
    """graph_id, idx, fx, fy: pulls along edges by size(distance), on both ends."""
    own = with_ends(g.edges.where("src <> dst"), nodes, "x", "y").withColumn("dx", F.col("b_x") - F.col("a_x")).withColumn("dy", F.col("b_y") - F.col("a_y"))
    own = own.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("d") > skip)
    f = size(F.col("d")) / F.col("d")
    pulled = own.select("graph_id", "src", "dst", (F.col("dx") * f).alias("fx"), (F.col("dy") * f).alias("fy"))
    both = pulled.select("graph_id", F.col("src").alias("idx"), "fx", "fy").unionByName(pulled.select("graph_id", F.col("dst").alias("idx"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))
    return both.groupBy("graph_id", "idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def _summed(nodes: DataFrame, *forces: DataFrame) -> DataFrame:
    """nodes with __fx, __fy."""
    every = forces[0]
    for f in forces[1:]:
        every = every.unionByName(f)
    total = every.groupBy("graph_id", "idx").agg(F.sum("fx").alias("__fx"), F.sum("fy").alias("__fy"))
    return nodes.join(total, ["graph_id", "idx"], "left").withColumn("__fx", F.coalesce("__fx", F.lit(0.0))).withColumn("__fy", F.coalesce("__fy", F.lit(0.0)))


def _moved(nodes: DataFrame, dx: Column, dy: Column, **more: Column) -> DataFrame:
    rest = [c for c in nodes.columns if c not in ("x", "y", *more) and not c.startswith("__")]
    step = lambda c, d: F.when(_free(), F.col(c) + d).otherwise(F.col(c)).alias(c)
    return nodes.select(*rest, step("x", dx), step("y", dy), *(v.alias(k) for k, v in more.items()))


def fruchterman_reingold_tick(g: Graph, nodes: DataFrame, size=(1000.0, 1000.0), temperature: float = 100.0, distance: float | None = None, gravity: float = 0.1, leaf: int = 0) -> DataFrame:
    """Repulsion k^2 / d, attraction d^2 / k, gravity to the centre; steps up to the temperature, inside the canvas."""
    w, h = check_canvas(size)
    counted = nodes.join(sizes(g).withColumnRenamed("n", "__n"), "graph_id")
    # k differs by graph: charges carry its root, so that their product is k^2
    k = F.lit(float(distance)) if distance else F.sqrt(F.lit(w * h) / F.col("__n"))
    scaled = counted.withColumn("k", k).drop("__n")
    away = all_forces(scaled, 1, 1.0, "k", leaf=leaf)
    pull = edge_forces(g, nodes, lambda d: d * d)
    pull = pull.join(scaled.groupBy("graph_id").agg(F.first("k").alias("k")), "graph_id").select("graph_id", "idx", (F.col("fx") / F.col("k")).alias("fx"), (F.col("fy") / F.col("k")).alias("fy"))
    centre = nodes.select("graph_id", "idx", (gravity * (w / 2 - F.col("x"))).alias("fx"), (gravity * (h / 2 - F.col("y"))).alias("fy"))
    own = _summed(nodes, away, pull, centre)
    f = F.sqrt(F.col("__fx") * F.col("__fx") + F.col("__fy") * F.col("__fy"))
    own = own.withColumn("__s", F.when(f > 0, F.least(f, F.lit(float(temperature))) / f).otherwise(0.0))
    moved = _moved(own, F.col("__fx") * F.col("__s"), F.col("__fy") * F.col("__s"))
    clamp = lambda c, hi: F.when(_free(), F.greatest(F.lit(0.0), F.least(F.lit(hi), F.col(c)))).otherwise(F.col(c))
    return moved.withColumn("x", clamp("x", w)).withColumn("y", clamp("y", h))


def spring_tick(g: Graph, nodes: DataFrame, size=(1000.0, 1000.0), stiffness: float = 0.1, spring_length: float = 100.0, repulsion: float = 10_000.0, damping: float = 0.5, gravity: float = 0.0, leaf: int = 0) -> DataFrame:
    """Hooke's law on edges (their length, else spring_length), Coulomb's between all; velocities (vx, vy) are damped."""
    w, h = check_canvas(size)
    for v in ("vx", "vy"):
        nodes = nodes if v in nodes.columns else nodes.withColumn(v, F.lit(0.0))
    away = all_forces(nodes, 2, repulsion, leaf=leaf)
    rest = F.coalesce(F.nullif("length", F.lit(0.0)), F.lit(spring_length))
    pull = edge_forces(Graph(g.nodes, g.edges), nodes, lambda d: stiffness * (d - rest))
    centre = nodes.select("graph_id", "idx", (gravity * (w / 2 - F.col("x"))).alias("fx"), (gravity * (h / 2 - F.col("y"))).alias("fy"))
    own = _summed(nodes, away, pull, centre)
    vx, vy = (F.col("vx") + F.col("__fx")) * damping, (F.col("vy") + F.col("__fy")) * damping
    still = lambda v: F.when(_free(), v).otherwise(0.0)
    return _moved(own, vx, vy, vx=still(vx), vy=still(vy))


def yifan_hu_tick(g: Graph, nodes: DataFrame, size=(1000.0, 1000.0), distance: float | None = None, strength: float = 0.2, shrink: float = 0.9, leaf: int = 0, cooling: bool = False) -> DataFrame:
    """Hu's forces: repulsion C K^2 / d, attraction d^2 / K; a node moves by its force, one step at most. State beside x, y,
    alike in all of a graph's nodes: the step, which before the move shrinks if the energy rose and grows after five falls in a
    row, or with `cooling` shrinks each tick; energy; falls. With `leaf`, forces and their sums are tables by turns, so that
    no two steps' shuffles are there at once and sums are made once; `passing` drops them."""
    w, h = check_canvas(size)
    held = (lambda make: passing(nodes.sparkSession, make)) if leaf else (lambda make: make())
    few = F.broadcast if leaf else (lambda df: df)  # large graphs aren't many
    ks = few(sizes(g).select("graph_id", (F.lit(float(distance)) if distance else F.sqrt(F.lit(w * h) / F.col("n"))).alias("k")))
    scaled = nodes.join(ks, "graph_id")
    for name, start in (("step", F.col("k") / 10), ("energy", F.lit(float("inf"))), ("falls", F.lit(0))):
        scaled = scaled if name in nodes.columns else scaled.withColumn(name, start)
    away = lambda: all_forces(scaled, 1, strength, "k", leaf=leaf)
    pull = lambda: edge_forces(g, nodes, lambda d: d * d).join(ks, "graph_id").select("graph_id", "idx", (F.col("fx") / F.col("k")).alias("fx"), (F.col("fy") / F.col("k")).alias("fy"))
    f = F.sqrt(F.col("__fx") * F.col("__fx") + F.col("__fy") * F.col("__fy"))
    own = held(lambda: _summed(scaled, held(away), held(pull)).withColumn("__f", f))
    total = own.groupBy("graph_id").agg(F.sum(F.col("__f") * F.col("__f")).alias("__e"))
    own = own.join(few(total), "graph_id")
    falls = F.when(F.col("__e") < F.col("energy"), F.col("falls") + 1).otherwise(0)
    step = F.when(falls >= 5, F.col("step") / shrink).when(F.col("__e") >= F.col("energy"), F.col("step") * shrink).otherwise(F.col("step"))
    own = own.withColumn("__step", F.col("step") * shrink if cooling else step)
    own = own.withColumn("__s", F.when(F.col("__f") > 0, F.least("__f", "__step") / F.col("__f")).otherwise(0.0))
    return _moved(own, F.col("__fx") * F.col("__s"), F.col("__fy") * F.col("__s"), step=F.col("__step"), energy=F.col("__e"), falls=F.when(falls >= 5, 0).otherwise(falls)).drop("k")


def force_atlas2_tick(g: Graph, nodes: DataFrame, size=(1000.0, 1000.0), scaling: float = 2.0, gravity: float = 1.0, strong: bool = False, linlog: bool = False, influence: float = 1.0, tolerance: float = 1.0, leaf: int = 0) -> DataFrame:
    """Degree-weighted repulsion and attraction, gravity, and speeds that follow each node's swinging. State beside
    x, y: px, py (the last forces) and speed, the graph's own, which rises by at most half of itself a tick. Forces below 0.01
    move nothing."""
    w, h = check_canvas(size)
    for v in ("px", "py"):
        nodes = nodes if v in nodes.columns else nodes.withColumn(v, F.lit(0.0))
    nodes = nodes if "speed" in nodes.columns else nodes.withColumn("speed", F.lit(1.0))
    heavy = nodes.drop("mass").join(degrees(g, 2).select("graph_id", "idx", (F.col("degree") + 1.0).alias("mass")), ["graph_id", "idx"])
    away = all_forces(heavy, 1, scaling, "mass", 0.01, leaf)
    weight = F.pow(F.coalesce("weight", F.lit(1.0)), F.lit(influence))
    pull = edge_forces(g, nodes, lambda d: weight * (F.log1p(d) if linlog else d), 0.01)
    dx, dy = w / 2 - F.col("x"), h / 2 - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    g1 = gravity * F.col("mass") * (F.lit(1.0) if strong else F.when(d > 0.01, 1 / d).otherwise(0.0))
    centre = heavy.select("graph_id", "idx", (dx * g1).alias("fx"), (dy * g1).alias("fy"))
    own = _summed(heavy, away, pull, centre)
    swing = F.sqrt(F.pow(F.col("__fx") - F.col("px"), F.lit(2)) + F.pow(F.col("__fy") - F.col("py"), F.lit(2)))
    drive = F.sqrt(F.pow(F.col("__fx") + F.col("px"), F.lit(2)) + F.pow(F.col("__fy") + F.col("py"), F.lit(2))) / 2
    own = own.withColumn("__swing", swing).withColumn("__drive", drive)
    swung, driven = F.sum(F.col("mass") * F.col("__swing")), F.sum(F.col("mass") * F.col("__drive"))
    goal = own.groupBy("graph_id").agg(F.when(swung > 0, F.lit(tolerance) * driven / swung).otherwise(1.0).alias("__goal"))
    own = own.join(goal, "graph_id").withColumn("__speed", F.least("__goal", 1.5 * F.col("speed")))
    f = F.sqrt(F.col("__fx") * F.col("__fx") + F.col("__fy") * F.col("__fy"))
    step = F.col("__speed") / (1 + F.col("__speed") * F.sqrt("__swing"))
    step = F.when(f >= 0.01, F.least(step, 10 / f)).otherwise(0.0)
    return _moved(own, F.col("__fx") * step, F.col("__fy") * step, px=F.col("__fx"), py=F.col("__fy"), speed=F.col("__speed")).drop("mass")


def _ideal(g: Graph, edge_length: float, apart: float | None) -> DataFrame:
    """graph_id, i, j, d for all pairs i <> j: hops * edge_length; pairs without a path get `apart` hops or the greater of
    1.5 times the longest distance and n."""
    hops = all_pairs(g).select("graph_id", F.col("source").alias("i"), F.col("idx").alias("j"), "dist")
    far = hops.groupBy("graph_id").agg(F.max("dist").alias("most")).join(sizes(g), "graph_id").select("graph_id", F.lit(apart).cast("double").alias("given"), F.greatest(F.col("most") * 1.5, F.col("n").cast("double")).alias("far"))
    a, b = g.nodes.select("graph_id", F.col("idx").alias("i")), g.nodes.select("graph_id", F.col("idx").alias("j"))
    every = a.join(b, "graph_id").where("i <> j").join(hops, ["graph_id", "i", "j"], "left").join(far, "graph_id")
    return every.select("graph_id", "i", "j", (F.coalesce("dist", "given", "far") * edge_length).alias("d"))


def stress_step(nodes: DataFrame, ideal: DataFrame) -> DataFrame:
    """One majorisation step in the form per node: x_i = sum w (x_j + d (x_i - x_j) / |x_i - x_j|) / sum w, w = 1 / d^2."""
    i = nodes.select("graph_id", F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    j = nodes.select("graph_id", F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    both = ideal.join(i, ["graph_id", "i"]).join(j, ["graph_id", "j"])
    dist = F.sqrt(F.pow(F.col("xi") - F.col("xj"), F.lit(2)) + F.pow(F.col("yi") - F.col("yj"), F.lit(2)))
    both = both.withColumn("r", F.when(dist > 1e-12, F.col("d") / dist).otherwise(0.0)).withColumn("w", 1 / (F.col("d") * F.col("d")))
    goal = both.groupBy("graph_id", F.col("i").alias("idx")).agg((F.sum(F.col("w") * (F.col("xj") + F.col("r") * (F.col("xi") - F.col("xj")))) / F.sum("w")).alias("__x"), (F.sum(F.col("w") * (F.col("yj") + F.col("r") * (F.col("yi") - F.col("yj")))) / F.sum("w")).alias("__y"))
    own = nodes.join(goal, ["graph_id", "idx"], "left")
    return _moved(own, F.coalesce("__x", "x") - F.col("x"), F.coalesce("__y", "y") - F.col("y"))


def raw_stress(nodes: DataFrame, ideal: DataFrame) -> DataFrame:
    """graph_id, stress: sum over i < j of (|x_i - x_j| - d)^2 / d^2."""
    i = nodes.select("graph_id", F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    j = nodes.select("graph_id", F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    dist = F.sqrt(F.pow(F.col("xi") - F.col("xj"), F.lit(2)) + F.pow(F.col("yi") - F.col("yj"), F.lit(2)))
    return ideal.where("i < j").join(i, ["graph_id", "i"]).join(j, ["graph_id", "j"]).groupBy("graph_id").agg(F.sum(F.pow(dist - F.col("d"), F.lit(2)) / F.pow("d", F.lit(2))).alias("stress"))


def spring_gradient(nodes: DataFrame, ideal: DataFrame) -> DataFrame:
    """graph_id, idx, gx, gy, norm: the gradient of sum (|x_i - x_j| - d)^2 / (2 d^2) (Kamada and Kawai)."""
    i = nodes.select("graph_id", F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    j = nodes.select("graph_id", F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    both = ideal.join(i, ["graph_id", "i"]).join(j, ["graph_id", "j"]).withColumn("dx", F.col("xi") - F.col("xj")).withColumn("dy", F.col("yi") - F.col("yj"))
    both = both.withColumn("l", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("l > 0").withColumn("f", (1 - F.col("d") / F.col("l")) / (F.col("d") * F.col("d")))
    out = both.groupBy("graph_id", F.col("i").alias("idx")).agg(F.sum(F.col("dx") * F.col("f")).alias("gx"), F.sum(F.col("dy") * F.col("f")).alias("gy"))
    return out.withColumn("norm", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def kamada_kawai_tick(nodes: DataFrame, ideal: DataFrame) -> DataFrame:
    """Newton's step for the free node with the greatest gradient of each graph (ties to the least idx); others stay."""
    i = nodes.where(_free()).select("graph_id", F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    j = nodes.select("graph_id", F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    both = ideal.join(i, ["graph_id", "i"]).join(j, ["graph_id", "j"]).withColumn("dx", F.col("xi") - F.col("xj")).withColumn("dy", F.col("yi") - F.col("yj"))
    both = both.withColumn("r", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("r > 0").withColumn("k", 1 / (F.col("d") * F.col("d"))).withColumn("c", F.col("d") / F.pow("r", F.lit(3)))
    dx, dy, k, c = (F.col(n) for n in ("dx", "dy", "k", "c"))
    pull = k * (1 - F.col("d") / F.col("r"))
    sums = both.groupBy("graph_id", F.col("i").alias("idx")).agg(
        F.sum(pull * dx).alias("gx"), F.sum(pull * dy).alias("gy"),
        F.sum(k * (1 - c * dy * dy)).alias("hxx"), F.sum(k * (1 - c * dx * dx)).alias("hyy"), F.sum(k * c * dx * dy).alias("hxy"),
    )
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    worst = sums.groupBy("graph_id").agg(F.max_by(F.struct("idx", "gx", "gy", "hxx", "hyy", "hxy"), F.struct(norm, -F.col("idx"))).alias("m")).select("graph_id", "m.*")
    det = F.col("hxx") * F.col("hyy") - F.col("hxy") * F.col("hxy")
    step = worst.select(
        "graph_id", "idx",
        F.when(F.abs(det) > 1e-18, (F.col("hxy") * F.col("gy") - F.col("hyy") * F.col("gx")) / det).alias("__dx"),
        F.when(F.abs(det) > 1e-18, (F.col("hxy") * F.col("gx") - F.col("hxx") * F.col("gy")) / det).alias("__dy"),
    )
    own = nodes.join(step, ["graph_id", "idx"], "left")
    return _moved(own, F.coalesce("__dx", F.lit(0.0)), F.coalesce("__dy", F.lit(0.0)))


def run(
    tick: Callable[[DataFrame, int], DataFrame], nodes: DataFrame, iterations: int = 300, every: int = 5, enough: float = 1e-3, listen: Callable[[Progress], bool | None] | None = None, first: int = 0, save: str | None = None,
) -> DataFrame:
    """Ticks until `iterations` or until nodes move less than `enough` a tick on average between two looks, `every` ticks
    apart. A listener that returns True stops the run. With `save`, a folder that all executors share, the state and the
    number of ticks are kept there at the end, from which `resume` goes on; ticks count from `first`."""
    check_iterations(iterations)
    keep = Rounds(nodes.sparkSession, every + 2)
    state = keep(nodes)
    tell = listen or (lambda p: None)
    stopped = tell(Progress("start", first, float("inf")))
    moved, t = float("inf"), first
    while t < first + iterations and not stopped:
        new = state
        for _ in range(min(every, first + iterations - t)):
            new = passing(nodes.sparkSession, lambda now=new, at=t: tick(now, at), keep)
            t += 1
        a, b = state.select("graph_id", "idx", F.col("x").alias("ox"), F.col("y").alias("oy")), new
        moved = b.join(a, ["graph_id", "idx"]).agg(F.avg(F.sqrt(F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2))))).first()[0] or 0.0
        state = new
        stopped = tell(Progress("tick", t, moved))
        if moved < enough * every:
            break
    if save is not None:
        state.withColumn("__ticks", F.lit(t)).write.mode("overwrite").parquet(save)
    tell(Progress("end", t, moved))
    return state


def resume(spark: SparkSession, tick: Callable[[DataFrame, int], DataFrame], saved: str, iterations: int = 300, **options) -> DataFrame:
    """A run that goes on from the folder `saved`, with what its ticks keep beside places; options are those of `run`. A state
    without nodes is returned as it is."""
    state = spark.read.parquet(saved)
    done = state.agg(F.max("__ticks")).first()[0]
    if done is None:
        return state.drop("__ticks")
    return run(tick, state.drop("__ticks"), iterations, first=done, **options)


def _by_size(g: Graph, size, centre: bool, in_task: int, tick: small_graphs.Tick, large: Callable[[Graph], DataFrame], iterations: int, enough: float = 1e-3) -> DataFrame:
    """The nodes of a run: graphs of at most in_task nodes in one task each, others by ticks as queries."""
    check_iterations(iterations)
    check_canvas(size)
    small, rest = small_graphs.by_size(g.settled(), in_task)
    out = small_graphs.run_in_tasks(small, tick, iterations, enough=enough)
    if rest is not None:
        out = out.unionByName(large(rest.settled()).select(out.columns))
    return centred(out, size) if centre else out


def fruchterman_reingold(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, cooling: float = 0.95, centre: bool = True, in_task: int = IN_TASK, **options) -> DataFrame:
    """options: distance, gravity and, for graphs of more than in_task nodes, leaf (0 for all pairs)."""
    w, h = check_canvas(size)
    cells = {"leaf": options.pop("leaf", LEAF)}
    tick = small_graphs.fruchterman_reingold_tick((w, h), lambda t: w / 10 * cooling**t, **options)
    large = lambda rest: run(lambda nodes, t: fruchterman_reingold_tick(rest, nodes, size, temperature=w / 10 * cooling**t, **options, **cells), rest.nodes, iterations)
    return _by_size(g, size, centre, in_task, tick, large, iterations)


def spring(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, centre: bool = True, in_task: int = IN_TASK, **options) -> DataFrame:
    """options: those of spring_tick; leaf for graphs of more than in_task nodes."""
    w, h = check_canvas(size)
    cells = {"leaf": options.pop("leaf", LEAF)}
    large = lambda rest: run(lambda nodes, _: spring_tick(rest, nodes, size, **options, **cells), rest.nodes, iterations).drop("vx", "vy")
    return _by_size(g, size, centre, in_task, small_graphs.spring_tick((w, h), **options), large, iterations)


def force_atlas2(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, centre: bool = True, in_task: int = IN_TASK, **options) -> DataFrame:
    """options: those of force_atlas2_tick; leaf for graphs of more than in_task nodes."""
    w, h = check_canvas(size)
    cells = {"leaf": options.pop("leaf", LEAF)}
    large = lambda rest: run(lambda nodes, _: force_atlas2_tick(rest, nodes, size, **options, **cells), rest.nodes, iterations, enough=0.01).drop("px", "py", "speed")
    return _by_size(g, size, centre, in_task, small_graphs.force_atlas2_tick((w, h), **options), large, iterations, 0.01)


def yifan_hu(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, centre: bool = True, in_task: int = IN_TASK, **options) -> DataFrame:
    """options: those of yifan_hu_tick; leaf for graphs of more than in_task nodes."""
    w, h = check_canvas(size)
    cells = {"leaf": options.pop("leaf", LEAF)}
    large = lambda rest: run(lambda nodes, _: yifan_hu_tick(rest, nodes, size, **options, **cells), rest.nodes, iterations).drop("step", "energy", "falls")
    return _by_size(g, size, centre, in_task, small_graphs.yifan_hu_tick((w, h), **options), large, iterations)


def stress_majorization(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, edge_length: float = 100.0, apart: float | None = None, centre: bool = True, in_task: int = IN_TASK) -> DataFrame:
    def large(rest: Graph) -> DataFrame:
        ideal = cut(_ideal(rest, edge_length, apart))
        return run(lambda nodes, _: stress_step(nodes, ideal), rest.nodes, iterations)

    return _by_size(g, size, centre, in_task, small_graphs.stress_tick(edge_length, apart), large, iterations)


def kamada_kawai(g: Graph, size=(1000.0, 1000.0), iterations: int = 300, edge_length: float = 100.0, apart: float | None = None, centre: bool = True) -> DataFrame:
    """One node a tick; for graphs where that is too slow, stress_majorization moves all nodes at once."""
    g = g.settled()
    ideal = cut(_ideal(g, edge_length, apart))
    out = run(lambda nodes, _: kamada_kawai_tick(nodes, ideal), g.nodes, iterations, every=10, enough=1e-5)
    return centred(out, size) if centre else out
