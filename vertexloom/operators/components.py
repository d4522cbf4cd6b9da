"""Weakly connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edges, so that no vertex's neighbourhood is gathered
in a task; the number of rounds grows with the logarithm of the longest path. State is a table in the shared
checkpoint folder after every round: a checkpoint would make each round's last stage twice and be read in as many tasks as
it was written in, however few rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import Rounds


def _starred(pairs: DataFrame, keys: list[str], smaller: bool) -> DataFrame:
    """Link what stands beside each u to the least vertex of its neighbourhood.

    smaller False (large star): every larger neighbour; True (small star): every smaller one and u itself.
    """
    both = pairs if smaller else pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, [*keys, "u"])
    if smaller:
        out = joined.select(*keys, F.col("v").alias("a"), "m").unionByName(least.select(*keys, F.col("u").alias("a"), "m"))
    else:
        out = joined.where("v > u").select(*keys, F.col("v").alias("a"), "m")
    return out.where("a <> m").select(*keys, F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", keys: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """One row (keys, node, component) for each vertex that an edge touches; component is the least vertex reachable.

    keys (such as graph_id) keep many graphs apart in one run. Edges with a null end are ignored. Isolated
    vertices have no row: a left join with coalesce(component, id) adds them. Raises after max_rounds.
    """
    k = list(keys)
    pairs = edges.select(*k, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNull().alias("n1"), F.col(dst).isNull().alias("n2")).where("not n1 and not n2").select(*k, "u", "v").distinct()
    rounds, pairs, before = Rounds(pairs.sparkSession), Rounds(pairs.sparkSession)(pairs), None
    loops = pairs.where("u = v").select(*k, F.col("u").alias("node"), F.col("u").alias("component"))
    state = pairs.where("u <> v")
    for _ in range(max_rounds):
        state = rounds(_starred(_starred(state, k, False), k, True))
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64(*k, "u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = state.select(*k, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(*k, F.col("v").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots).unionByName(loops).groupBy(*k, "node").agg(F.min("component").alias("component"))
