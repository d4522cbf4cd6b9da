"""Blocks of large graphs by way of a core: a small part of the graph whose large blocks most edges turn out to lie in.

What a long loop over all edges would tell is told by a few joins. The core is some of the nodes of high degree, with the
edges between them and the paths of two edges through nodes outside it, one for each such node; of these each core node
takes two. A block of that is part of one block of the graph. A node with two neighbours in it is in the same block, and so
on outwards. An edge with both ends in one block is in that block; only the others go the long way, together with a stand-in for each
large block. Nothing is left to chance but how many these are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import kept

LEAST = 16  # edges of a core's block from which on it counts as large
HOMES = 10_000  # large blocks at most, so that a table of them can be broadcast


def _core(inner: DataFrame, degrees: DataFrame) -> Callable[[Column, Column], Column] | None:
    """Whether a node (graph_id beside it) of a degree is in the core; None if no core is small and joined up enough.

    Of the nodes whose degree is the greatest power of two that three in four edges reach, one in 2^i: the greatest i for
    which the core gets six edges a node, counted as if neighbours were drawn at random.
    """
    level = lambda c: F.floor(F.log2(F.col(c) + 0.5))
    edges = [tuple(r) for r in inner.groupBy(level("da"), level("db")).count().collect()]
    nodes = dict(tuple(r) for r in degrees.where("degree > 1").groupBy(level("degree")).count().collect())
    every, n = sum(c for *_, c in edges), sum(nodes.values())
    for j in range(max(nodes, default=0), 0, -1):
        reach = sum(c for _, b, c in edges if b >= j)
        if 4 * reach < 3 * every or not reach:
            continue
        high, among = sum(c for k, c in nodes.items() if k >= j), sum(c for a, _, c in edges if a >= j)
        for i in range(12, -1, -1):
            share = 2.0**-i
            met = share * reach / n
            paths = n * (1 - math.exp(-met) * (1 + met)) + among * share * share
            if paths >= 6 * share * high and 4 * share * high <= n:
                return lambda node, degree: (degree >= 2**j) & (F.pmod(F.xxhash64(node, "graph_id", F.lit(7)), F.lit(2**i)) == 0)  # noqa: B023
        return None
    return None


def _core_edges(inner: DataFrame, inside: Callable[[Column, Column], Column], base: int) -> DataFrame:
    """graph_id, eid, src, dst: two edges of each core node (those of others to it beside them); a path through a node has base and that node's number as eid."""
    marked = inner.withColumn("ka", inside(F.col("a"), F.col("da"))).where(inside(F.col("b"), F.col("db")))
    straight = marked.where("ka").select("graph_id", "eid", "a", "b")
    by = F.xxhash64("b", "a")
    through = marked.where("not ka").groupBy("a", "graph_id").agg(F.min_by("b", by).alias("p"), F.max_by("b", by).alias("q")).where("p <> q")
    every = straight.unionByName(through.select("graph_id", (F.col("a") + base).alias("eid"), F.col("p").alias("a"), F.col("q").alias("b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    by = F.xxhash64("eid")
    pick = [f(c, by).alias(f"{name}_{c}") for name, f in (("x", F.min_by), ("y", F.max_by)) for c in ("eid", "other")]
    taken = every.select("graph_id", "eid", both.alias("e")).select("graph_id", "eid", "e.*").groupBy("node", "graph_id").agg(*pick)
    two = F.explode(F.array(*(F.struct(F.col(f"{x}_eid").alias("eid"), F.col(f"{x}_other").alias("other")) for x in "xy")))
    taken = taken.select("graph_id", "node", two.alias("e"))
    return kept(taken.select("graph_id", "e.eid", F.least("node", "e.other").alias("src"), F.greatest("node", "e.other").alias("dst")).distinct())


def _homes(core: DataFrame, found: DataFrame) -> DataFrame:
    """graph_id, node, home: of the large blocks that a core node is in the largest, by its least node."""
    found = kept(found)
    sizes = found.groupBy("graph_id", "block").agg(F.count("*").alias("n")).where(F.col("n") >= max(LEAST, -(-found.count() // HOMES)))
    ends = core.join(found, ["eid", "graph_id"]).join(F.broadcast(sizes), ["graph_id", "block"])
    ends = ends.select("graph_id", "block", "n", F.explode(F.array("src", "dst")).alias("node"))
    own = kept(ends.groupBy("node", "graph_id").agg(F.max(F.struct("n", "block")).alias("h")).select("graph_id", "node", "h.block"))
    least = own.groupBy("graph_id", "block").agg(F.min("node").alias("home"))
    return kept(own.join(F.broadcast(least), ["graph_id", "block"]).select("graph_id", "node", "home"))


def _joined(inner: DataFrame, homes: DataFrame, near: str, end: str) -> DataFrame:
    """homes, and with them the nodes at the end `end` of edges whose other ends are two nodes or more of one home."""
    met = inner.select("graph_id", near, end).join(homes.withColumnRenamed("node", near).hint("shuffle_hash"), [near, "graph_id"])
    met = met.groupBy(end, "graph_id", "home").agg(F.min(near).alias("x"), F.max(near).alias("y")).where("x < y")
    new = met.groupBy(end, "graph_id").agg(F.max("home").alias("home")).select("graph_id", F.col(end).alias("node"), "home")
    return kept(homes.unionByName(new.join(homes, ["node", "graph_id"], "left_anti")))


def by_core(edges: DataFrame, blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """graph_id, eid, block of each edge (graph_id, eid, src, dst; no loops), as `blocks` gives them for all edges.

    In what goes to `blocks` in the end, a large block is two nodes joined to each of its nodes that other edges touch: that is one block
    as well, and which blocks further edges join depends on nothing else.
    """
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    degrees = kept(ends.groupBy("node", "graph_id").agg(F.count("*").alias("degree")))
    # nodes are fewer than edges: a hash table of a partition's nodes spares sorting the edges
    end = lambda name, d: degrees.select("graph_id", F.col("node").alias(name), F.col("degree").alias(d)).hint("shuffle_hash")
    rows = edges.join(end("src", "ds"), ["src", "graph_id"]).join(end("dst", "dd"), ["dst", "graph_id"])
    # a is the end of lower degree, so no node is the a of more edges than the root of twice their number
    first = F.struct("ds", "src") < F.struct("dd", "dst")
    pick = lambda c, x, y: [F.when(first, F.col(x)).otherwise(F.col(y)).alias(f"{c}a"), F.when(first, F.col(y)).otherwise(F.col(x)).alias(f"{c}b")]
    rows = kept(rows.select("graph_id", "eid", *pick("", "src", "dst"), *pick("d", "ds", "dd")))
    lone, inner = rows.where("da = 1"), rows.where("da > 1")
    inside = _core(inner, degrees)
    if inside is None:
        return blocks(edges)
    base = edges.agg(F.max("eid")).first()[0] + 1
    core = _core_edges(inner, inside, base)
    homes = _homes(core, blocks(core))
    n, now, near, end = degrees.where("degree > 1").count(), homes.count(), "b", "a"
    while now:
        homes, before = _joined(inner, homes, near, end), now
        now, near, end = homes.count(), end, near
        if now >= 0.95 * n or (now - before < 0.05 * n and near == "b"):
            break
    at = lambda c: homes.select("graph_id", F.col("node").alias(c), F.col("home").alias(f"h{c}")).hint("shuffle_hash")
    rows = kept(inner.select("graph_id", "eid", "a", "b").join(at("b"), ["b", "graph_id"], "left").join(at("a"), ["a", "graph_id"], "left"))
    own, rest = rows.where("ha = hb"), rows.where("ha is null or hb is null or ha <> hb")
    touched = rest.select("graph_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ha").alias("home")), F.struct(F.col("b").alias("node"), F.col("hb").alias("home")))).alias("t")).select("graph_id", "t.*").where("home is not null").distinct()
    stands = kept(touched.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("graph_id", "home", (base + 2 * F.col("node") + F.col("k")).alias("eid"), (-2 * F.col("home") - 1 - F.col("k")).alias("src"), F.col("node").alias("dst")))
    rest = kept(rest.select("graph_id", "eid", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(stands.drop("home")))
    found = kept(blocks(rest))
    # names: the least eid of a block, of the homes in it too
    classes = stands.join(found, ["eid", "graph_id"]).groupBy("graph_id", "home").agg(F.min("block").alias("block"))
    names = own.groupBy("graph_id", F.col("ha").alias("home")).agg(F.min("eid").alias("least")).join(classes, ["graph_id", "home"], "full")
    names = kept(names.select("graph_id", "home", "least", "block"))
    met = names.where("block is not null").groupBy("graph_id", "block").agg(F.min("least").alias("least")).withColumn("least", F.least("least", "block"))
    own_names = names.join(F.broadcast(met.withColumnRenamed("least", "joined")), ["graph_id", "block"], "left").select("graph_id", F.col("home").alias("ha"), F.coalesce("joined", "least").alias("block"))
    out = lone.select("graph_id", "eid", F.col("eid").alias("block"))
    out = out.unionByName(own.join(F.broadcast(kept(own_names)), ["graph_id", "ha"]).select("graph_id", "eid", "block"))
    left = found.where(F.col("eid") < base).join(F.broadcast(met), ["graph_id", "block"], "left")
    return out.unionByName(left.select("graph_id", "eid", F.coalesce("least", "block").alias("block")))
