"""Edges in canonical form, degrees, adjacency, and validation of links and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.sources.graphs import Graph


class ValidationError(ValueError):
    """Input that a layout can't take."""


class InvalidCanvasSizeError(ValidationError):
    pass


class InvalidNodeError(ValidationError):
    pass


class InvalidLinkError(ValidationError):
    pass


class InvalidGroupError(ValidationError):
    pass


def check_canvas(size) -> tuple[float, float]:
    if len(size) < 2 or not (size[0] > 0 and size[1] > 0):
        raise InvalidCanvasSizeError(f"canvas must be two positive numbers, not {size}")
    return float(size[0]), float(size[1])


def check_iterations(iterations: int) -> int:
    if iterations < 1:
        raise ValidationError(f"iterations must be 1 at least, not {iterations}")
    return int(iterations)


def check_alpha(alpha: float) -> float:
    if not 0 <= alpha <= 1:
        raise ValidationError(f"alpha must be from 0 to 1, not {alpha}")
    return float(alpha)


def sizes(g: Graph) -> DataFrame:
    """(graph_id, n): the number of nodes of each graph."""
    return g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))


def invalid_links(g: Graph) -> DataFrame:
    """graph_id, eid, problem for each edge with an end that is null or not a node (outside 0 .. n - 1)."""
    ends = g.edges.join(sizes(g), "graph_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    name = lambda c: F.when(F.col(c).isNull(), f"{c} is null").when((F.col(c) < 0) | (F.col(c) >= F.col("n")), f"{c} out of range")
    return ends.withColumn("problem", F.coalesce(name("src"), name("dst"))).where("problem is not null").select("graph_id", "eid", "problem")


def invalid_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, gid, member, kind for members of groups (leaves, children) that don't exist."""
    each = lambda c, kind: groups.select("graph_id", "gid", F.explode(c).alias("member"), F.lit(kind).alias("kind"))
    leaves = each("leaves", "leaf").join(nodes.select("graph_id", F.col("idx").alias("member")), ["graph_id", "member"], "left_anti")
    children = each("children", "group").join(groups.select("graph_id", F.col("gid").alias("member")), ["graph_id", "member"], "left_anti")
    return leaves.unionByName(children).select("graph_id", "gid", "member", "kind")


def validate(g: Graph, groups: DataFrame | None = None) -> Graph:
    """g, if all links and groups are sound; else raises and names the first fault."""
    if bad := invalid_links(g).orderBy("graph_id", "eid").first():
        raise InvalidLinkError(f"graph {bad.graph_id}, edge {bad.eid}: {bad.problem}")
    if groups is not None and (bad := invalid_groups(groups, g.nodes).orderBy("graph_id", "gid", "member").first()):
        raise InvalidGroupError(f"graph {bad.graph_id}, group {bad.gid}: no {bad.kind} {bad.member}")
    return g


def in_range(g: Graph) -> DataFrame:
    """The edges whose ends are both nodes."""
    return g.edges.join(sizes(g), "graph_id").where("src >= 0 and dst >= 0 and src < n and dst < n").drop("n")


def canonical_edges(g: Graph) -> DataFrame:
    """graph_id, eid, src, dst: without loops and repeated pairs; of a pair the first edge stays as it stands."""
    pairs = in_range(g).where("src <> dst")
    first = pairs.groupBy("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by(F.struct("eid", "src", "dst"), "eid").alias("e"))
    return first.select("graph_id", "e.eid", "e.src", "e.dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a loop stands twice."""
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.unionByName(edges.select(*(turned.get(c, c) for c in edges.columns)))


def degrees(g: Graph, loop: int = 2) -> DataFrame:
    """graph_id, idx, degree of all nodes; a loop counts `loop` (1 or 2)."""
    edges = in_range(g)
    ends = edges.select("graph_id", F.col("src").alias("idx")).unionByName(edges.where("src <> dst" if loop == 1 else "true").select("graph_id", F.col("dst").alias("idx")))
    found = ends.groupBy("graph_id", "idx").agg(F.count("*").alias("degree"))
    return g.nodes.select("graph_id", "idx").join(found, ["graph_id", "idx"], "left").select("graph_id", "idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(g: Graph) -> DataFrame:
    """graph_id, idx, neighbours in the order of edges; a loop stands twice."""
    sides = both_ways(in_range(g).select("graph_id", "eid", "src", "dst"))
    found = sides.groupBy("graph_id", F.col("src").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("eid", "dst"))).alias("e"))
    return g.nodes.select("graph_id", "idx").join(found, ["graph_id", "idx"], "left").select("graph_id", "idx", F.coalesce(F.col("e.dst"), F.array().cast("array<long>")).alias("neighbours"))


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with the given columns of both ends, as a_<column> and b_<column>; edges without both nodes go."""
    for end, mark in (("src", "a"), ("dst", "b")):
        own = nodes.select("graph_id", F.col("idx").alias(end), *(F.col(c).alias(f"{mark}_{c}") for c in columns))
        edges = edges.join(own, ["graph_id", end])
    return edges
