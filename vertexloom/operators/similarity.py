"""Edge lengths from how alike the ends' neighbourhoods are, and separation constraints between strong components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.ingest import both_ways, in_range
from vertexloom.operators.traversal import strong_components
from vertexloom.sources.graphs import Graph


def neighbour_counts(g: Graph) -> DataFrame:
    """graph_id, eid, src, dst, nu, nv, shared: the sizes of both ends' neighbour sets and of their intersection.

    Shared neighbours are counted by a join over the middle node, not by gathering sets.
    """
    sides = both_ways(in_range(g).select("graph_id", "src", "dst")).distinct()
    size = sides.groupBy("graph_id", "src").agg(F.count("*").alias("n"))
    edges = in_range(g).select("graph_id", "eid", "src", "dst")
    mid = edges.alias("e").join(sides.alias("a"), (F.col("e.graph_id") == F.col("a.graph_id")) & (F.col("e.src") == F.col("a.src"))).join(sides.alias("b"), (F.col("e.graph_id") == F.col("b.graph_id")) & (F.col("e.dst") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")))
    shared = mid.groupBy(F.col("e.graph_id").alias("graph_id"), F.col("e.eid").alias("eid")).agg(F.count("*").alias("shared"))
    out = edges.join(size.withColumnRenamed("n", "nu"), ["graph_id", "src"]).join(size.withColumnsRenamed({"src": "dst", "n": "nv"}), ["graph_id", "dst"]).join(shared, ["graph_id", "eid"], "left")
    return out.withColumn("shared", F.coalesce("shared", F.lit(0)))


def _lengths(g: Graph, f: Column, w: float) -> DataFrame:
    return neighbour_counts(g).select("graph_id", "eid", (1 + w * f).alias("length"))


def symmetric_difference_lengths(g: Graph, w: float = 1.0) -> DataFrame:
    """1 + w * sqrt(|union| - |intersection|)."""
    return _lengths(g, F.sqrt((F.col("nu") + F.col("nv") - 2 * F.col("shared")).cast("double")), w)


def jaccard_lengths(g: Graph, w: float = 1.0) -> DataFrame:
    """1 + w * |intersection| / |union|; the share is 0 where the smaller set has fewer than 1.1 members."""
    share = F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))
    return _lengths(g, F.when(F.least("nu", "nv") < 1.1, 0.0).otherwise(share), w)


def separation_constraints(g: Graph, gap: float = 1.0, axis: str = "y") -> DataFrame:
    """graph_id, axis, left, right, gap, equality: one for each edge between two strong components."""
    scc = strong_components(g)
    edges = in_range(g).select("graph_id", "eid", "src", "dst")
    both = edges.join(scc.withColumnsRenamed({"idx": "src", "component": "c1"}), ["graph_id", "src"]).join(scc.withColumnsRenamed({"idx": "dst", "component": "c2"}), ["graph_id", "dst"])
    return both.where("c1 <> c2").select("graph_id", F.lit(axis).alias("axis"), F.col("src").alias("left"), F.col("dst").alias("right"), F.lit(float(gap)).alias("gap"), F.lit(False).alias("equality"))
