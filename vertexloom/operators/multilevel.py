"""Coarsening by matching, multilevel force layout, spectral and barycentric placements, trees, acyclic orientation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.functions.numbers import uniform
from vertexloom.operators import force
from vertexloom.operators.ingest import both_ways, check_canvas, in_range, sizes
from vertexloom.operators.static_layouts import centred, random_layout
from vertexloom.operators.traversal import longest_path_layers, strong_components
from vertexloom.plans.lineage import cut
from vertexloom.sources.graphs import Graph, numbered


def matching(g: Graph, seed: int = 0, max_rounds: int = 50) -> DataFrame:
    """graph_id, a, b (a < b): a maximal matching. Every free node asks its free neighbour over the edge of least hash;
    who ask each other are matched; the rest go on. Raises after max_rounds."""
    edges = in_range(g).where("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = cut(edges.withColumn("h", F.xxhash64(F.lit(seed), "src", "dst")))
    done = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        asked = both_ways(edges).groupBy("graph_id", "src").agg(F.min_by("dst", F.struct("h", F.least("src", "dst"), F.greatest("src", "dst"))).alias("dst"))
        new = cut(asked.alias("p").join(asked.alias("q"), (F.col("p.graph_id") == F.col("q.graph_id")) & (F.col("p.src") == F.col("q.dst")) & (F.col("p.dst") == F.col("q.src")) & (F.col("p.src") < F.col("p.dst"))).select("p.graph_id", F.col("p.src").alias("a"), F.col("p.dst").alias("b")))
        done = new if done is None else done.unionByName(new)
        taken = new.select("graph_id", F.col("a").alias("v")).unionByName(new.select("graph_id", F.col("b").alias("v")))
        for end in ("src", "dst"):
            edges = edges.join(taken.withColumnRenamed("v", end), ["graph_id", end], "left_anti")
        edges = cut(edges.select("graph_id", "src", "dst", "h"))
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"matching did not settle in {max_rounds} rounds")
    return done if done is not None else g.nodes.sparkSession.createDataFrame([], "graph_id string, a long, b long")


def coarsened(g: Graph, seed: int = 0) -> tuple[Graph, DataFrame]:
    """The graph of matched pairs and lone nodes, and (graph_id, idx, coarse). Edges are distinct, without loops."""
    pairs = matching(g, seed)
    twin = pairs.select("graph_id", F.col("b").alias("idx"), F.col("a").alias("rep"))
    named = g.nodes.select("graph_id", "idx").join(twin, ["graph_id", "idx"], "left").withColumn("rep", F.coalesce("rep", "idx"))
    order = F.dense_rank().over(W.Window.partitionBy("graph_id").orderBy("rep")) - 1
    mapped = cut(named.withColumn("coarse", order.cast("long")).drop("rep"))
    edges = in_range(g).select("graph_id", "src", "dst")
    for end in ("src", "dst"):
        edges = edges.join(mapped.withColumnsRenamed({"idx": end, "coarse": f"c_{end}"}), ["graph_id", end])
    fine = edges.where("c_src <> c_dst").select("graph_id", F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).distinct()
    nodes = mapped.select("graph_id", F.col("coarse").alias("idx")).distinct()
    nodes = nodes.select("*", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("fixed"))
    return Graph(nodes, cut(numbered(fine, "eid", "src", "dst").withColumn("length", F.lit(None).cast("double")).withColumn("weight", F.lit(None).cast("double")))), mapped


def multilevel(g: Graph, size=(1000.0, 1000.0), iterations: int = 60, smallest: int = 10, ratio: float = 0.75, seed: int = 0, max_levels: int = 20, **options) -> DataFrame:
    """Yifan Hu's layout from coarse to fine: levels by matching until a graph is small or shrinks by less than `ratio`;
    each level starts from its parents' places with a small hashed offset and takes fewer ticks. options: those of
    force.yifan_hu."""
    check_canvas(size)
    levels, maps = [g.settled()], []
    while len(levels) < max_levels:
        n = levels[-1].nodes.count()
        if n <= smallest:
            break
        small, mapped = coarsened(levels[-1], seed + len(levels))
        if small.nodes.count() > ratio * n:
            break
        levels.append(small)
        maps.append(mapped)
    top = levels[-1]
    nodes = random_layout(top, size, seed=seed)
    for depth in range(len(levels) - 1, -1, -1):
        nodes = cut(force.yifan_hu(levels[depth].with_nodes(nodes), size, max(5, iterations // (1 + depth)), centre=False, **options))
        if depth:
            parent = nodes.select("graph_id", F.col("idx").alias("coarse"), F.col("x").alias("__x"), F.col("y").alias("__y"))
            fine = levels[depth - 1].nodes.join(maps[depth - 1], ["graph_id", "idx"]).join(parent, ["graph_id", "coarse"])
            jitter = lambda c, axis: F.when(F.coalesce("fixed", F.lit(0)) == 0, F.col(f"__{c}") + (uniform(seed, axis, F.col("idx")) - 0.5) * 2).otherwise(F.col(c))
            nodes = cut(fine.withColumn("x", jitter("x", 2)).withColumn("y", jitter("y", 3)).drop("coarse", "__x", "__y"))
    return centred(nodes, size)


def spectral(g: Graph, size=(1000.0, 1000.0), rounds: int = 60, seed: int = 1, padding: float = 50.0) -> DataFrame:
    """Two leading non-trivial eigenvectors of the normalised adjacency by orthogonal iteration, scaled to the canvas.

    A round multiplies both vectors by (I + D^-1/2 A D^-1/2) / 2 over the edges, takes out the trivial vector
    (sqrt of the degree) and the first from the second by one-row sums, and scales them to length 1.
    """
    w, h = check_canvas(size)
    sides = both_ways(in_range(g).where("src <> dst").select("graph_id", "src", "dst", F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)).alias("w")))
    sides = sides.groupBy("graph_id", "src", "dst").agg(F.max("w").alias("w"))
    deg = cut(g.nodes.select("graph_id", "idx").join(sides.groupBy("graph_id", F.col("src").alias("idx")).agg(F.sum("w").alias("deg")), ["graph_id", "idx"], "left").withColumn("root", F.sqrt(F.coalesce("deg", F.lit(0.0)))).drop("deg"))
    norm = cut(sides.join(deg.withColumnsRenamed({"idx": "src", "root": "r1"}), ["graph_id", "src"]).join(deg.withColumnsRenamed({"idx": "dst", "root": "r2"}), ["graph_id", "dst"]).select("graph_id", "src", "dst", (F.col("w") / (F.col("r1") * F.col("r2"))).alias("w")))

    def tidy(v: DataFrame) -> DataFrame:
        """v (graph_id, idx, root, x, y) with x and y orthogonal to root and to each other, of length 1."""
        s = lambda a, b: F.sum(F.col(a) * F.col(b))
        one = v.groupBy("graph_id").agg((s("x", "root") / F.greatest(s("root", "root"), F.lit(1e-300))).alias("a"), (s("y", "root") / F.greatest(s("root", "root"), F.lit(1e-300))).alias("b"))
        v = cut(v.join(one, "graph_id").withColumn("x", F.col("x") - F.col("a") * F.col("root")).withColumn("y", F.col("y") - F.col("b") * F.col("root")).drop("a", "b"))
        two = v.groupBy("graph_id").agg(F.greatest(F.sqrt(s("x", "x")), F.lit(1e-300)).alias("n"), (s("x", "y") / F.greatest(s("x", "x"), F.lit(1e-300))).alias("c"))
        v = v.join(two, "graph_id").withColumn("y", F.col("y") - F.col("c") * F.col("x")).withColumn("x", F.col("x") / F.col("n")).drop("n", "c")
        three = v.groupBy("graph_id").agg(F.greatest(F.sqrt(s("y", "y")), F.lit(1e-300)).alias("n"))
        return v.join(three, "graph_id").withColumn("y", F.col("y") / F.col("n")).drop("n")

    state = cut(tidy(deg.withColumn("x", uniform(seed, 0, F.col("idx")) - 0.5).withColumn("y", uniform(seed, 1, F.col("idx")) - 0.5)))
    for _ in range(rounds):
        pulled = norm.join(state.select("graph_id", F.col("idx").alias("dst"), "x", "y"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.sum(F.col("w") * F.col("x")).alias("ax"), F.sum(F.col("w") * F.col("y")).alias("ay"))
        new = state.join(pulled, ["graph_id", "idx"], "left").select("graph_id", "idx", "root", *((F.col(c) / 2 + F.coalesce(f"a{c}", F.lit(0.0)) / 2).alias(c) for c in ("x", "y")))
        state = cut(tidy(cut(new)))
    unit = state.select("graph_id", "idx", *(F.when(F.col("root") > 0, F.col(c) / F.col("root")).otherwise(0.0).alias(c) for c in ("x", "y")))
    box = unit.groupBy("graph_id").agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    fit = lambda c, full: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), padding + (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * (full - 2 * padding)).otherwise(full / 2)
    placed = unit.join(box, "graph_id").select("graph_id", "idx", fit("x", w).alias("x"), fit("y", h).alias("y"))
    return g.nodes.drop("x", "y").join(placed, ["graph_id", "idx"])


def barycentric(g: Graph, outer: DataFrame, size=(1000.0, 1000.0), rounds: int = 200, enough: float = 1e-3) -> DataFrame:
    """Tutte's placement: outer (graph_id, idx, pos) evenly on a circle, all others in the mean of their neighbours, by
    repeated averaging."""
    w, h = check_canvas(size)
    n = outer.groupBy("graph_id").agg(F.count("*").alias("n"))
    angle = F.lit(2 * math.pi) * F.col("pos") / F.col("n")
    rim = outer.join(n, "graph_id").select("graph_id", "idx", (w / 2 + (w / 2 - 40) * F.cos(angle)).alias("rx"), (h / 2 + (h / 2 - 40) * F.sin(angle)).alias("ry"))
    g = g.settled()
    start = g.nodes.drop("x", "y").join(rim, ["graph_id", "idx"], "left").withColumn("x", F.coalesce("rx", F.lit(w / 2))).withColumn("y", F.coalesce("ry", F.lit(h / 2)))
    sides = cut(both_ways(in_range(g).where("src <> dst").select("graph_id", "src", "dst")).distinct())

    def tick(nodes: DataFrame, _: int) -> DataFrame:
        mean = sides.join(nodes.select("graph_id", F.col("idx").alias("dst"), "x", "y"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        return nodes.join(mean, ["graph_id", "idx"], "left").withColumn("x", F.coalesce("rx", "mx", "x")).withColumn("y", F.coalesce("ry", "my", "y")).drop("mx", "my")

    return force.run(tick, start, rounds, every=5, enough=enough).drop("rx", "ry")


def layered_tree(g: Graph, level_separation: float = 100.0, node_separation: float = 50.0) -> DataFrame:
    """Leaves side by side in the order of the tree's edges, parents over the middle of their first and last child."""
    edges = in_range(g).where("src <> dst").groupBy("graph_id", "dst").agg(F.min_by(F.struct("eid", "src"), "eid").alias("e")).select("graph_id", F.col("dst").alias("idx"), "e.src", "e.eid")
    level = longest_path_layers(Graph(g.nodes, edges.select("graph_id", "src", F.col("idx").alias("dst"))))
    tree = cut(level.join(edges, ["graph_id", "idx"], "left"))
    depth = tree.agg(F.max("layer")).first()[0] or 0
    inner = tree.select("graph_id", F.col("src").alias("idx")).where("idx is not null").distinct()
    count = tree.join(inner, ["graph_id", "idx"], "left_anti").select("graph_id", "idx", F.lit(1).cast("long").alias("leaves"))
    for d in range(depth - 1, -1, -1):
        count = cut(count).unionByName(tree.where(F.col("layer") == d + 1).join(count, ["graph_id", "idx"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.sum("leaves").alias("leaves")))
    own = cut(tree.join(count, ["graph_id", "idx"]))
    before = W.Window.partitionBy("graph_id", "src", "layer").orderBy(F.coalesce("eid", "idx")).rowsBetween(W.Window.unboundedPreceding, -1)
    skipped = own.withColumn("skip", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
    at = skipped.where("src is null").select("graph_id", "idx", F.col("skip").alias("first"))
    rows = at
    for d in range(1, depth + 1):
        up = at.select("graph_id", F.col("idx").alias("src"), F.col("first").alias("pf"))
        at = skipped.where((F.col("layer") == d) & F.col("src").isNotNull()).join(up, ["graph_id", "src"]).select("graph_id", "idx", (F.col("pf") + F.col("skip")).alias("first"))
        rows = rows.unionByName(at)
    x = cut(own.join(rows, ["graph_id", "idx"]).withColumn("x", F.when(F.col("leaves") == 1, F.col("first") * node_separation)))
    known = x.where("x is not null").select("graph_id", "idx", "x")
    for d in range(depth - 1, -1, -1):
        mid = x.where(F.col("layer") == d + 1).select("graph_id", "idx", "src").join(known, ["graph_id", "idx"]).groupBy("graph_id", F.col("src").alias("idx")).agg(((F.min("x") + F.max("x")) / 2).alias("x"))
        mid = cut(mid)
        known = known.join(mid.select("graph_id", "idx"), ["graph_id", "idx"], "left_anti").unionByName(mid)
    placed = level.join(known, ["graph_id", "idx"]).select("graph_id", "idx", "x", (F.col("layer") * level_separation).alias("y"))
    return g.nodes.drop("x", "y").join(placed, ["graph_id", "idx"])


def acyclic_edges(g: Graph) -> DataFrame:
    """graph_id, eid, src, dst, reversed: without loops; edges inside a strong component go from smaller to greater idx, so
    that no cycle is left."""
    scc = strong_components(g)
    own = in_range(g).where("src <> dst").select("graph_id", "eid", "src", "dst")
    for end, name in (("src", "c1"), ("dst", "c2")):
        own = own.join(scc.withColumnsRenamed({"idx": end, "component": name}), ["graph_id", end])
    back = (F.col("c1") == F.col("c2")) & (F.col("src") > F.col("dst"))
    return own.select("graph_id", "eid", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), back.alias("reversed"))


def width_bounded_layers(layers: DataFrame, max_width: int) -> DataFrame:
    """layers (graph_id, idx, layer) with neighbouring layers merged, greedily from the first, up to max_width nodes."""
    counts = layers.groupBy("graph_id", "layer").agg(F.count("*").alias("c")).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("layer", "c"))).alias("l"))
    fold = F.expr(f"aggregate(l, named_struct('m', map(), 'at', 0L, 'w', 0L), (s, x) -> if(s.w > 0 and s.w + x.c > {max_width}, named_struct('m', map_concat(s.m, map(x.layer, s.at + 1)), 'at', s.at + 1, 'w', x.c), named_struct('m', map_concat(s.m, map(x.layer, s.at)), 'at', s.at, 'w', s.w + x.c)), s -> s.m)".replace("map()", "cast(map() as map<bigint,bigint>)"))
    merged = counts.select("graph_id", F.explode(fold).alias("layer", "to"))
    return layers.join(merged, ["graph_id", "layer"]).select("graph_id", "idx", F.col("to").alias("layer"))


def is_planar_possible(g: Graph) -> DataFrame:
    """graph_id, possible: Euler's bound of 3 n - 6 distinct edges (n from 3 on); false means the graph isn't planar."""
    pairs = in_range(g).where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("graph_id").agg(F.count("*").alias("m"))
    return sizes(g).join(pairs, "graph_id", "left").select("graph_id", (F.coalesce("m", F.lit(0)) <= F.when(F.col("n") < 3, F.col("n")).otherwise(3 * F.col("n") - 6)).alias("possible"))
