"""Fixpoints over edges: breadth-first layers, shortest paths, longest-path layers, cycles, strong components,
two-colouring. State is one row per node (or per source and node); each round is a join and an aggregate, lineage
is cut every round, and a one-row aggregate tells when nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.components import component_labels
from vertexloom.operators.ingest import both_ways, in_range, sizes
from vertexloom.plans.lineage import Rounds, cut
from vertexloom.sources.graphs import Graph


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """Apply step until no row of the state changes; raises after max_rounds."""
    state, before = cut(state), None
    for _ in range(max_rounds):
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64(*state.columns)), F.sum(F.pmod(F.xxhash64(*state.columns), F.lit(1 << 31)))).first()
        if now == before:
            return state
        before, state = now, cut(step(state))
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def components(g: Graph) -> DataFrame:
    """graph_id, idx, component: the least node reachable when edges go both ways."""
    labels = component_labels(in_range(g), keys=("graph_id",)).withColumnRenamed("node", "idx")
    return g.nodes.select("graph_id", "idx").join(labels, ["graph_id", "idx"], "left").withColumn("component", F.coalesce("component", "idx"))


def is_connected(g: Graph) -> DataFrame:
    """graph_id, connected: one component at most."""
    return components(g).groupBy("graph_id").agg((F.countDistinct("component") <= 1).alias("connected"))


def distances(g: Graph, sources: DataFrame, weight: str | None = None, directed: bool = False, default: float = 1.0, max_rounds: int = 10_000) -> DataFrame:
    """graph_id, source, idx, dist, prev of all nodes reachable from the sources (graph_id, source).

    Without a weight column, hops. Only improvements of the round before are relaxed. prev is the least node
    before idx on a shortest path (null at the source).
    """
    edges = in_range(g).where("src <> dst")
    cost = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(default))
    edges = edges.select("graph_id", "src", "dst", cost.alias("cost"))
    edges = edges if directed else both_ways(edges)
    edges = cut(edges.groupBy("graph_id", "src", "dst").agg(F.min("cost").alias("cost")))
    best = sources.select("graph_id", F.col("source").cast("long").alias("source"), F.col("source").cast("long").alias("idx"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"), F.lit(True).alias("fresh"))
    best = cut(best.distinct())
    for _ in range(max_rounds):
        reached = best.where("fresh").join(edges, [best.graph_id == edges.graph_id, best.idx == edges.src]).select(best.graph_id, "source", F.col("dst").alias("idx"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("src").alias("prev"))
        both = best.select("graph_id", "source", "idx", "dist", "prev", F.lit(0).alias("new")).unionByName(reached.withColumn("new", F.lit(1)))
        top = both.groupBy("graph_id", "source", "idx").agg(F.min(F.struct("dist", "new", "prev")).alias("b"))
        best = cut(top.select("graph_id", "source", "idx", "b.dist", "b.prev", (F.col("b.new") == 1).alias("fresh")))
        if best.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    back = best.alias("s").join(edges.alias("e"), (F.col("s.graph_id") == F.col("e.graph_id")) & (F.col("s.idx") == F.col("e.src")))
    prev = back.join(best.alias("t"), (F.col("t.graph_id") == F.col("s.graph_id")) & (F.col("t.source") == F.col("s.source")) & (F.col("t.idx") == F.col("e.dst")) & (F.col("t.dist") == F.col("s.dist") + F.col("e.cost")))
    least = prev.groupBy(F.col("t.graph_id").alias("graph_id"), F.col("t.source").alias("source"), F.col("t.idx").alias("idx")).agg(F.min("s.idx").alias("prev"))
    out = best.drop("prev", "fresh").join(least, ["graph_id", "source", "idx"], "left")
    return out.select("graph_id", "source", "idx", "dist", F.when(F.col("idx") != F.col("source"), F.col("prev")).alias("prev"))


def all_pairs(g: Graph, weight: str | None = None, default: float = 1.0) -> DataFrame:
    """Distances from every node; pairs without a path have no row."""
    return distances(g, g.nodes.select("graph_id", F.col("idx").alias("source")), weight, default=default)


def shortest_path(g: Graph, graph_id: str, source: int, target: int, weight: str | None = None) -> list[int]:
    """Nodes from source to target; empty without a path. The way back is marked by pointers that double their reach each
    round, so rounds are the logarithm of the path's length; the driver gets the path's own rows."""
    spark = g.nodes.sparkSession
    start = spark.createDataFrame([(graph_id, source)], "graph_id string, source long")
    back = cut(distances(g, start, weight).select("idx", "prev"))
    marked, size, reach = cut(back.where(F.col("idx") == target).select("idx", F.lit(0).cast("long").alias("k"))), 0, 1
    pointers = back.where("prev is not null")
    while (now := marked.count()) > size:
        size = now
        further = marked.join(pointers, "idx").select(F.col("prev").alias("idx"), (F.col("k") + reach).alias("k"))
        marked = cut(marked.unionByName(further).distinct())
        pointers = cut(pointers.join(pointers.select(F.col("idx").alias("prev"), F.col("prev").alias("next")), "prev").select("idx", F.col("next").alias("prev")))
        reach *= 2
    return [r.idx for r in marked.orderBy(F.desc("k")).collect()]


def paths_with_turns(g: Graph, asked: DataFrame, turn: Callable[[Column, Column, Column], Column], weight: str | None = None, default: float = 1.0, max_rounds: int = 10_000) -> DataFrame:
    """graph_id, source, target, dist, path of the asked pairs (graph_id, source, target) where each step also costs
    turn(node before, node, node after), 0 at the least; pairs without a path have no row, ties go to the least path.

    A state is the edge last walked, so a round joins edges with those that follow; only improvements of the round before go
    on. A hub of degree k stands for k * k pairs of edges, by the problem's nature.
    """
    edges = in_range(g).where("src <> dst")
    cost = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(default))
    darts = cut(both_ways(edges.select("graph_id", "src", "dst", cost.alias("cost"))).groupBy("graph_id", "src", "dst").agg(F.min("cost").alias("cost")))
    sources = asked.select("graph_id", F.col("source").cast("long").alias("source")).distinct()
    keep = Rounds(g.nodes.sparkSession)
    first = sources.join(darts.withColumnRenamed("src", "source"), ["graph_id", "source"])
    state = keep(first.select("graph_id", "source", F.col("source").alias("a"), F.col("dst").alias("b"), F.col("cost").alias("dist"), F.array("source", "dst").alias("path"), F.lit(True).alias("fresh")))
    for _ in range(max_rounds):
        on = state.where("fresh").join(darts.withColumnsRenamed({"src": "b", "dst": "c"}), ["graph_id", "b"])
        dist = F.col("dist") + F.col("cost") + turn(F.col("a"), F.col("b"), F.col("c"))
        new = on.select("graph_id", "source", F.col("b").alias("a"), F.col("c").alias("b"), dist.alias("dist"), F.concat("path", F.array("c")).alias("path"), F.lit(1).alias("new"))
        both = state.drop("fresh").withColumn("new", F.lit(0)).unionByName(new)
        best = both.groupBy("graph_id", "source", "a", "b").agg(F.min(F.struct("dist", "path", "new")).alias("m"))
        state = keep(best.select("graph_id", "source", "a", "b", "m.dist", "m.path", (F.col("m.new") == 1).alias("fresh")))
        if state.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"paths did not settle in {max_rounds} rounds")
    ended = state.groupBy("graph_id", "source", F.col("b").alias("target")).agg(F.min(F.struct("dist", "path")).alias("m")).select("graph_id", "source", "target", "m.dist", "m.path")
    pairs = asked.select("graph_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
    here = pairs.where("source = target").join(g.nodes.select("graph_id", F.col("idx").alias("source")), ["graph_id", "source"], "left_semi")
    here = here.select("graph_id", "source", "target", F.lit(0.0).alias("dist"), F.array("source").alias("path"))
    return pairs.where("source <> target").join(ended, ["graph_id", "source", "target"]).unionByName(here)


def bfs_layers(g: Graph, root: int = 0) -> DataFrame:
    """graph_id, idx, layer: hops from the root; what it can't reach is in layer 0."""
    start = sizes(g).select("graph_id", F.lit(root).alias("source"))
    found = distances(g, start).select("graph_id", "idx", F.col("dist").cast("long").alias("layer"))
    return g.nodes.select("graph_id", "idx").join(found, ["graph_id", "idx"], "left").withColumn("layer", F.coalesce("layer", F.lit(0).cast("long")))


def longest_path_layers(g: Graph) -> DataFrame:
    """graph_id, idx, layer: the longest way from nodes without incoming edges, n - 1 at most on cycles.

    Where every node has an incoming edge, node 0 starts; what isn't reached is in layer 0.
    """
    edges = cut(in_range(g).select("graph_id", "src", "dst").distinct())
    entered = edges.select("graph_id", F.col("dst").alias("idx")).distinct()
    roots = g.nodes.select("graph_id", "idx").join(entered, ["graph_id", "idx"], "left_anti")
    none = sizes(g).join(roots, "graph_id", "left_anti").select("graph_id", F.lit(0).cast("long").alias("idx"))
    count = sizes(g)

    def step(state: DataFrame) -> DataFrame:
        pushed = edges.join(state.withColumnRenamed("idx", "src"), ["graph_id", "src"]).join(count, "graph_id").select("graph_id", F.col("dst").alias("idx"), F.least(F.col("layer") + 1, F.col("n") - 1).alias("layer"))
        return state.unionByName(pushed).groupBy("graph_id", "idx").agg(F.max("layer").alias("layer"))

    found = fixpoint(roots.unionByName(none).withColumn("layer", F.lit(0).cast("long")), step)
    return g.nodes.select("graph_id", "idx").join(found, ["graph_id", "idx"], "left").withColumn("layer", F.coalesce("layer", F.lit(0).cast("long")))


def peel(g: Graph) -> DataFrame:
    """graph_id, idx, level: when a node loses its last incoming edge from what is left; nodes on or behind cycles have null."""
    edges = cut(in_range(g).select("graph_id", "src", "dst").distinct())
    state, level = cut(g.nodes.select("graph_id", "idx", F.lit(None).cast("long").alias("level"))), 0
    while True:
        left = state.where("level is null").select("graph_id", "idx")
        entered = edges.join(left.withColumnRenamed("idx", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("idx"))
        free = cut(left.join(entered, ["graph_id", "idx"], "left_anti").withColumn("now", F.lit(level).cast("long")))
        if free.isEmpty():
            return state
        # one table of all nodes from round to round, so that the plan doesn't grow with their number
        state, level = cut(state.join(free, ["graph_id", "idx"], "left").select("graph_id", "idx", F.coalesce("level", "now").alias("level"))), level + 1


def has_cycle(g: Graph) -> DataFrame:
    """graph_id, has_cycle (a loop is one)."""
    return peel(g).groupBy("graph_id").agg(F.max(F.col("level").isNull()).alias("has_cycle"))


def topological_order(g: Graph) -> DataFrame:
    """graph_id, idx, pos: every edge goes to a later position (by level, then idx); graphs with a cycle have no rows."""
    levels = cut(peel(g))
    cyclic = levels.where("level is null").select("graph_id").distinct()
    from pyspark.sql import window as W

    order = W.Window.partitionBy("graph_id").orderBy("level", "idx")
    return levels.join(cyclic, "graph_id", "left_anti").withColumn("pos", F.row_number().over(order).cast("long") - 1).drop("level")


def strong_components(g: Graph) -> DataFrame:
    """graph_id, idx, component: the least node that it reaches and is reached by.

    Rounds of colouring: the greatest label flows forward to a fixpoint, then, backward from each label's own node
    inside its colour, one component per colour is taken out; what is left goes on. Labels are negated
    positions of a fixed shuffle, so that long chains don't take one round each.
    """
    edges = cut(in_range(g).select("graph_id", "src", "dst").where("src <> dst").distinct())
    left, done = cut(g.nodes.select("graph_id", "idx")), None
    while True:
        alive = cut(edges.join(left.withColumnRenamed("idx", "src"), ["graph_id", "src"], "left_semi").join(left.withColumnRenamed("idx", "dst"), ["graph_id", "dst"], "left_semi"))

        def forward(state: DataFrame, alive=alive) -> DataFrame:
            pushed = alive.join(state.withColumnRenamed("idx", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("idx"), "color")
            return state.unionByName(pushed).groupBy("graph_id", "idx").agg(F.max("color").alias("color"))

        colors = fixpoint(left.withColumn("color", F.struct(F.xxhash64("idx").alias("h"), F.col("idx").alias("i"))), forward)
        inside = alive.join(colors.withColumnsRenamed({"idx": "src", "color": "c1"}), ["graph_id", "src"]).join(colors.withColumnsRenamed({"idx": "dst", "color": "c2"}), ["graph_id", "dst"]).where("c1 = c2").select("graph_id", "src", "dst")
        inside = cut(inside)

        def backward(state: DataFrame, inside=inside) -> DataFrame:
            pulled = inside.join(state.withColumnRenamed("idx", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("idx"), "color")
            return state.unionByName(pulled).distinct()

        found = fixpoint(colors.where("color.i = idx"), backward)
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, ["graph_id", "idx"], "left_anti"))
        if left.isEmpty():
            break
    least = done.groupBy("graph_id", "color").agg(F.min("idx").alias("component"))
    return done.join(least, ["graph_id", "color"]).select("graph_id", "idx", "component")


def two_colouring(g: Graph) -> DataFrame:
    """graph_id, idx, side (0 or 1, the least node of each component has 0), bipartite (of the whole graph).

    Components of the double cover: (v, 0) and (v, 1) are joined over every edge crosswise; where both copies of a
    node meet, its component has an odd cycle. Loops are odd cycles.
    """
    edges = in_range(g).select("graph_id", "src", "dst")
    cover = edges.select("graph_id", (F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst")).unionByName(edges.select("graph_id", (F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2).alias("dst")))
    labels = cut(component_labels(cover, keys=("graph_id",)))
    even = labels.where("node % 2 = 0").select("graph_id", (F.col("node") / 2).cast("long").alias("idx"), F.col("component").alias("c0"))
    odd = labels.where("node % 2 = 1").select("graph_id", ((F.col("node") - 1) / 2).cast("long").alias("idx"), F.col("component").alias("c1"))
    both = even.join(odd, ["graph_id", "idx"])
    out = g.nodes.select("graph_id", "idx").join(both, ["graph_id", "idx"], "left")
    bad = both.groupBy("graph_id").agg(F.max(F.col("c0") == F.col("c1")).alias("odd"))
    side = F.when(F.col("c0").isNull() | (F.col("c0") <= F.col("c1")), 0).otherwise(1)
    return out.withColumn("side", side).join(bad, "graph_id", "left").select("graph_id", "idx", "side", (~F.coalesce("odd", F.lit(False))).alias("bipartite"))
