"""Layered drawings: crossing counts between layers, barycentre sweeps, dummy nodes of long edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.operators.ingest import both_ways, in_range
from vertexloom.operators.traversal import longest_path_layers
from vertexloom.plans.lineage import cut, kept
from vertexloom.sources.graphs import Graph


def positions(layers: DataFrame) -> DataFrame:
    """graph_id, idx, layer, pos: places in the layer by idx, from 0."""
    order = W.Window.partitionBy("graph_id", "layer").orderBy("idx")
    return layers.withColumn("pos", F.row_number().over(order).cast("long") - 1)


BLOCK = 200_000  # edges that a task counts together


def _inversions(key: np.ndarray, top: np.ndarray, bottom: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each edge, c times the edges (as often as c says) of its key with a lesser top and a greater bottom."""
    order = np.lexsort((bottom, top, key))
    # in this order edges of one top, or of two keys, aren't out of order, nor are those of one bottom
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((top[order], bottom[order], key[order]))] = np.arange(len(order))
    count, found = c[order].astype(np.int64), np.zeros(len(order), np.int64)
    at = np.arange(len(order))  # edges in order of the ranks' higher bits, within these in the first order
    for bit in range(max(0, len(order) - 1).bit_length() - 1, -1, -1):
        above, set_ = rank[at] >> (bit + 1), (rank[at] >> bit) & 1 == 1
        before = np.cumsum(np.where(set_, count[at], 0))
        first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        begun = np.repeat(before[first] - np.where(set_[first], count[at[first]], 0), np.diff(np.append(first, len(at))))
        found[at[~set_]] += (before - begun)[~set_]
        at = at[np.lexsort((set_, above))]
    out = np.empty(len(order), np.int64)
    out[order] = found * count
    return out


def _within(block: str, top: str, keys: list[str], schema: str, edges: DataFrame) -> DataFrame:
    """keys, crossings between the edges of one block each."""

    def counted(table: pa.Table) -> pa.Table:
        code = np.zeros(table.num_rows, np.int64)
        for k in keys:
            own = table[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            code = np.unique(np.stack([code, own.astype(np.int64)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        found = _inversions(code, *(table[c].to_numpy() for c in (top, "bottom", "c")))
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, back, found)
        return pa.table([*(table[k].take(pa.array(first)) for k in keys), pa.array(sums)], [*keys, "crossings"])

    return edges.groupBy(block).applyInArrow(counted, schema)


def _by_bits(cells: DataFrame, keys: list[str], tops: int, bottoms: int) -> DataFrame:
    """keys, crossings between cells (t, b, c) with t < tops and b < bottoms.

    Two numbers differ first in one bit. So the crossings are, over all bits i of tops and j of bottoms and all values
    of the bits above them, the edges with bit i clear and bit j set times those with bit i set and bit j clear.
    """
    bits = lambda most: F.array(*(F.lit(i) for i in range(max(1, (most - 1).bit_length()))))
    cells = cells.withColumn("i", F.explode(bits(tops))).withColumn("j", F.explode(bits(bottoms)))
    one = lambda c, at: F.expr(f"(shiftright({c}, {at}) & 1) = 1")
    cells = cells.where(one("t", "i") != one("b", "j"))
    sums = cells.groupBy(*keys, "i", "j", F.expr("shiftright(t, i + 1)").alias("above_t"), F.expr("shiftright(b, j + 1)").alias("above_b")).agg(F.sum(F.when(one("b", "j"), F.col("c")).otherwise(0)).alias("left"), F.sum(F.when(one("t", "i"), F.col("c")).otherwise(0)).alias("right"))
    return sums.groupBy(*keys).agg(F.sum(F.col("left") * F.col("right")).cast("long").alias("crossings"))


def bilayer_crossings(pairs: DataFrame, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """keys, crossings of edges (top, bottom) between two rows: pairs with t1 < t2 and b1 > b2, repeated edges too.

    The edges in order of keys, top, bottom, and in that of keys, bottom, top, are cut into blocks of about `block` edges, in
    a row's node too if need be. Two edges that cross are in one block of the first order, or else in one of the second, or in
    different ones of both. So each edge is dealt twice, to be counted within its blocks, and what crosses between blocks is
    counted from the number of edges in each two blocks. top and bottom are whole numbers; nulls don't count.
    """
    k = list(keys)
    counts = cut(pairs.where("top is not null and bottom is not null").groupBy(*k, F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom")).agg(F.count("*").alias("c")))
    blocks = max(1, -(-counts.count() // block))
    dealt = counts
    for name, order in (("t", ("top", "bottom")), ("b", ("bottom", "top"))):
        # kept, as the ranges' bounds must not be found anew
        dealt = kept(dealt.repartitionByRange(blocks, *k, *order).withColumn(name, F.spark_partition_id().cast("long")))
    schema = ", ".join([*(f"{c} {counts.schema[c].dataType.simpleString()}" for c in k), "crossings long"])
    cells = dealt.groupBy(*k, "t", "b").agg(F.sum("c").alias("c"))
    parts = _within("t", "top", k, schema, dealt).unionByName(_within("b", "t", k, schema, dealt)).unionByName(_by_bits(cells, k, blocks, blocks))
    total = F.coalesce(F.sum("crossings"), F.lit(0)).cast("long").alias("crossings")
    return (parts.groupBy(*k) if k else parts).agg(total)


def layered_crossings(g: Graph, places: DataFrame) -> DataFrame:
    """graph_id, crossings of edges drawn from (pos, layer) to (pos, layer): strictly inside both, no common node."""
    from vertexloom.operators.metrics import crossing_points

    nodes = g.nodes.drop("x", "y").join(places.select("graph_id", "idx", F.col("pos").cast("double").alias("x"), F.col("layer").cast("double").alias("y")), ["graph_id", "idx"])
    found = crossing_points(g.with_nodes(nodes)).groupBy("graph_id").agg(F.count("*").alias("crossings"))
    return g.nodes.select("graph_id").distinct().join(found, "graph_id", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)).cast("long"))


def order_layer(g: Graph, places: DataFrame, layer: int, toward: int) -> DataFrame:
    """places with one layer in order of the mean position of its neighbours in layer + toward (-1 or 1); ties and
    nodes without such keep their order."""
    edges = both_ways(in_range(g).select("graph_id", "src", "dst").where("src <> dst"))
    other = places.where(F.col("layer") == layer + toward).select("graph_id", F.col("idx").alias("dst"), F.col("pos").alias("p"))
    mean = edges.join(other, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("idx")).agg(F.avg("p").alias("mean"))
    own = places.where(F.col("layer") == layer).join(mean, ["graph_id", "idx"], "left")
    order = W.Window.partitionBy("graph_id").orderBy(F.coalesce("mean", F.col("pos").cast("double")), "pos", "idx")
    ranked = own.withColumn("pos", F.row_number().over(order).cast("long") - 1).select("graph_id", "idx", "layer", "pos")
    return ranked.unionByName(places.where(F.col("layer") != layer).select("graph_id", "idx", "layer", "pos"))


def minimize_crossings(g: Graph, places: DataFrame, iterations: int = 24) -> DataFrame:
    """Sweeps down and up in turn; lineage is cut after each layer."""
    g = g.settled()
    depth = places.agg(F.max("layer")).first()[0] or 0
    for i in range(iterations):
        for layer in range(1, depth + 1) if i % 2 == 0 else range(depth - 1, -1, -1):
            places = cut(order_layer(g, places, layer, -1 if i % 2 == 0 else 1))
    return places


def dummy_nodes(g: Graph, layers: DataFrame) -> DataFrame:
    """graph_id, eid, layer, dummy: one node for each layer that an edge passes, numbered on from n by (eid, layer)."""
    own = in_range(g).select("graph_id", "eid", "src", "dst")
    for end in ("src", "dst"):
        own = own.join(layers.select("graph_id", F.col("idx").alias(end), F.col("layer").alias(f"l_{end}")), ["graph_id", end])
    lo, hi = F.least("l_src", "l_dst"), F.greatest("l_src", "l_dst")
    passed = own.where(hi - lo > 1).select("graph_id", "eid", F.explode(F.sequence(lo + 1, hi - 1)).alias("layer"))
    count = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    order = W.Window.partitionBy("graph_id").orderBy("eid", "layer")
    return passed.join(count, "graph_id").select("graph_id", "eid", "layer", (F.col("n") + F.row_number().over(order) - 1).alias("dummy"))


def layered(g: Graph, layer_separation: float = 100.0, node_separation: float = 50.0, iterations: int = 24) -> DataFrame:
    """Nodes of a DAG in rows of longest-path layers, ordered by sweeps over proper edges (with dummies), rows centred."""
    g = g.settled()
    layers = cut(longest_path_layers(g))
    dummies = cut(dummy_nodes(g, layers))
    chain = in_range(g).select("graph_id", "eid", F.col("src").alias("v")).join(layers.select("graph_id", F.col("idx").alias("v"), "layer"), ["graph_id", "v"])
    chain = chain.unionByName(in_range(g).select("graph_id", "eid", F.col("dst").alias("v")).join(layers.select("graph_id", F.col("idx").alias("v"), "layer"), ["graph_id", "v"])).unionByName(dummies.select("graph_id", "eid", F.col("dummy").alias("v"), "layer"))
    hop = F.lead("v").over(W.Window.partitionBy("graph_id", "eid").orderBy("layer"))
    parts = chain.withColumn("dst", hop).where("dst is not null").select("graph_id", F.col("v").alias("src"), "dst")
    every = layers.select("graph_id", "idx", "layer").unionByName(dummies.select("graph_id", F.col("dummy").alias("idx"), "layer"))
    proper = Graph(every, cut(parts.withColumn("eid", F.lit(0).cast("long"))))
    places = minimize_crossings(proper, cut(positions(every)), iterations)
    row = W.Window.partitionBy("graph_id", "layer")
    at = places.withColumn("x", (F.col("pos") - (F.count("*").over(row) - 1) / 2) * node_separation).withColumn("y", F.col("layer") * layer_separation)
    return g.nodes.drop("x", "y").join(at.select("graph_id", "idx", "x", "y"), ["graph_id", "idx"])
