"""Graphs as DataFrames.

nodes: graph_id string, idx long (dense from 0 in each graph), further columns such as x, y, width, height,
fixed, label. edges: graph_id string, eid long (dense in each graph), src long, dst long, length double, weight
double. Every operator keys by graph_id, so many graphs run in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import cut

NODE = "graph_id string, idx long, x double, y double, width double, height double, fixed int, label string"
EDGE = "graph_id string, eid long, src long, dst long, length double, weight double"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(nodes, self.edges)

    def settled(self) -> Graph:
        """The same with lineage cut: what a loop reads in every round isn't made from its sources each time."""
        return Graph(cut(self.nodes), cut(self.edges))


def _blank(df: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """df with all columns of the schema, in its types; further columns stay behind them."""
    wanted = [c.split() for c in schema.split(", ")]
    own = [(F.col(n) if n in df.columns else defaults.get(n, F.lit(None))).cast(t).alias(n) for n, t in wanted]
    return df.select(*own, *(c for c in df.columns if c not in {n for n, _ in wanted}))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a dense number from 0 in each graph, in the given order."""
    return df.withColumn(name, F.row_number().over(W.Window.partitionBy("graph_id").orderBy(*order)).cast("long") - 1)


def graph(nodes: DataFrame | None, edges: DataFrame, graph_id: str = "g") -> Graph:
    """A Graph from frames with src, dst (and idx) and whatever else they have; without nodes, 0 .. the greatest end."""
    edges = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit(graph_id))
    if "eid" not in edges.columns:
        edges = numbered(edges, "eid", "src", "dst")
    if nodes is None:
        last = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).alias("last"))
        nodes = last.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("idx"))
    nodes = nodes if "graph_id" in nodes.columns else nodes.withColumn("graph_id", F.lit(graph_id))
    zero = {"x": F.lit(0.0), "y": F.lit(0.0), "fixed": F.lit(0)}
    return Graph(_blank(nodes, NODE, zero), _blank(edges, EDGE, {}))


def densify(nodes: DataFrame, edges: DataFrame, key: str = "id") -> Graph:
    """Dense idx by order of any node key; edges (src, dst are keys) follow by two joins. Unknown ends become null."""
    nodes = nodes if "graph_id" in nodes.columns else nodes.withColumn("graph_id", F.lit("g"))
    edges = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit("g"))
    found = numbered(nodes, "idx", key)
    names = found.select("graph_id", F.col(key).alias("__key"), "idx")
    for end in ("src", "dst"):
        own = names.withColumnRenamed("idx", "__idx").withColumnRenamed("__key", end)
        edges = edges.join(own, ["graph_id", end], "left").withColumn(end, F.col("__idx")).drop("__idx")
    return graph(found, edges)


# --- files -----------------------------------------------------------------


def read_edge_csv(spark: SparkSession, path: str, graph_id: str = "g") -> Graph:
    """Edge list without a header; lines that start with # are comments."""
    rows = spark.read.option("comment", "#").schema("src long, dst long").csv(path)
    return graph(None, rows, graph_id)


def read_json(spark: SparkSession, path: str, graph_id: str = "g") -> Graph:
    """{"nodes": [{"id": ...}], "links": [{"source": ..., "target": ...}]}."""
    kind = "nodes array<struct<id:long,label:string,x:double,y:double,width:double,height:double>>, links array<struct<source:long,target:long,length:double,weight:double>>"
    both = spark.read.schema(kind).option("multiLine", True).json(path)
    nodes = both.select(F.posexplode("nodes").alias("__at", "n")).select(F.col("__at").cast("long").alias("idx"), "n.*")
    links = both.select(F.posexplode("links").alias("eid", "l")).select(F.col("eid").cast("long").alias("eid"), F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.length", "l.weight")
    return graph(nodes, links, graph_id)


def read_graphml(spark: SparkSession, path: str, graph_id: str = "g") -> Graph:
    """Nodes and edges of GraphML files by Spark's XML reader (row tags node and edge)."""
    reader = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)
    nodes = reader("node", "_id string").select(F.col("_id").alias("id"), F.col("_id").alias("label"))
    edges = reader("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    found = densify(nodes.withColumn("id", F.struct(number.alias("n"), "id")), edges.select(*(F.struct(F.regexp_extract(c, r"(\d+)$", 1).cast("long").alias("n"), F.col(c).alias("id")).alias(c) for c in ("src", "dst"))))
    return Graph(found.nodes.drop("id").withColumn("graph_id", F.lit(graph_id)), found.edges.withColumn("graph_id", F.lit(graph_id)))


def read_gml(spark: SparkSession, path: str, graph_id: str = "g") -> Graph:
    """Nodes and edges of GML files: blocks of `node [ id N label "..." ]` and `edge [ source N target N ]`."""
    text = spark.read.text(path, wholetext=True)
    block = lambda name: F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{name}\s*\[(.*?)\]"), F.lit(1)))
    field = lambda c, name: F.regexp_extract(c, rf"\b{name}\s+(-?\d+)", 1).cast("long")
    nodes = text.select(block("node").alias("b")).select(field("b", "id").alias("id"), F.nullif(F.regexp_extract("b", r'\blabel\s+"([^"]*)"', 1), F.lit("")).alias("label"))
    edges = text.select(block("edge").alias("b")).select(field("b", "source").alias("src"), field("b", "target").alias("dst"))
    found = densify(nodes, edges)
    return Graph(found.nodes.drop("id").withColumn("graph_id", F.lit(graph_id)), found.edges.withColumn("graph_id", F.lit(graph_id)))


# --- graphs in the TPC-H-like tables ---------------------------------------


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: line items from supplier nations to customer nations."""
    line, orders, customer, supplier = _tables(spark, sf_dir, "lineitem", "orders", "customer", "supplier")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def trade3(spark: SparkSession, sf_dir: str) -> Graph:
    """Per nation its three heaviest partners; nodes 0 .. 24."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("label"))
    best = W.Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = trade(spark, sf_dir).where("src <> dst").withColumn("r", F.row_number().over(best)).where("r <= 3").drop("r")
    return graph(nation, top)


def trade1(spark: SparkSession, sf_dir: str) -> Graph:
    """Per nation its heaviest partner: one edge from each node."""
    g = trade3(spark, sf_dir)
    first = W.Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return graph(g.nodes, g.edges.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "eid"))


def dag(spark: SparkSession, sf_dir: str) -> Graph:
    """trade3's edges from smaller to larger nations."""
    g = trade3(spark, sf_dir)
    return graph(g.nodes, g.edges.where("src < dst").drop("eid"))


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) pairs of line items."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(F.col("l_partkey").alias("top"), F.col("l_suppkey").alias("bottom")).distinct()


def part_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders and, after them, parts; an edge for each distinct pair of line items, its eid made of both."""
    line, part, orders = _tables(spark, sf_dir, "lineitem", "part", "orders")
    first, parts = (t.agg((F.max(c) + 1).cast("long")).first()[0] or 0 for t, c in ((orders, "o_orderkey"), (part, "p_partkey")))
    pairs = line.select(F.col("l_orderkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("p")).distinct()
    edges = pairs.select("src", (F.col("p") + first).alias("dst"), (F.col("src") * parts + F.col("p")).alias("eid"))
    return graph(spark.range(first + parts).select(F.col("id").alias("idx")), edges)


def spark_nodes(pairs: DataFrame, parts: int) -> DataFrame:
    """graph_id, idx for all parts (0 .. parts - 1) and, from there on, suppliers."""
    most = pairs.agg((F.max("bottom") + 1).alias("m"))
    return most.select(F.lit("g").alias("graph_id"), F.explode(F.sequence(F.lit(0).cast("long"), parts + F.col("m") - 1)).alias("idx"))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types and how often one follows another of the same user; nodes in order of name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    after = events.select("event_type", F.lead("event_type").over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt")).where("nxt is not null")
    pairs = after.groupBy(F.col("event_type").alias("src"), F.col("nxt").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    names = events.select(F.col("event_type").alias("id")).distinct().withColumn("label", F.col("id"))
    g = densify(names, pairs)
    return Graph(g.nodes.drop("id"), g.edges)


def user_transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """One graph for each user: the event types they had, in order of name, and which followed which."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").withColumn("graph_id", F.col("user_id").cast("string"))
    after = events.select("graph_id", F.col("event_type").alias("src"), F.lead("event_type").over(W.Window.partitionBy("graph_id").orderBy("ts", "event_id")).alias("dst")).where("dst is not null")
    names = events.select("graph_id", F.col("event_type").alias("id")).distinct().withColumn("label", F.col("id"))
    g = densify(names, after.groupBy("graph_id", "src", "dst").agg(F.count("*").cast("double").alias("weight")))
    return Graph(g.nodes.drop("id"), g.edges)


def customer_chains(spark: SparkSession, sf_dir: str) -> Graph:
    """One graph for each nation, a chain of its customers in every market segment; and one for each region, a star."""
    customer, nation, region = _tables(spark, sf_dir, "customer", "nation", "region")
    own = customer.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("graph_id"), "c_mktsegment", F.col("c_custkey").alias("id"))
    link = F.lead("id").over(W.Window.partitionBy("graph_id", "c_mktsegment").orderBy("id"))
    chains = own.select("graph_id", F.col("id").alias("src"), link.alias("dst")).where("dst is not null")
    name = F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("graph_id")
    rim = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(name, F.lit(-1).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    nodes = own.select("graph_id", "id").unionByName(rim.select("graph_id", F.col("dst").alias("id"))).unionByName(region.select(name, F.lit(-1).cast("long").alias("id")))
    g = densify(nodes, chains.unionByName(rim))
    return Graph(g.nodes.drop("id"), g.edges)


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """A tree: root 0, regions, nations, then customers and suppliers."""
    region, nation, customer, supplier = _tables(spark, sf_dir, "region", "nation", "customer", "supplier")
    many = customer.agg((F.max("c_custkey") + 1).alias("many"))
    levels = [
        region.select(F.lit(0).cast("long").alias("src"), (1 + F.col("r_regionkey")).cast("long").alias("dst")),
        nation.select((1 + F.col("n_regionkey")).cast("long").alias("src"), (6 + F.col("n_nationkey")).cast("long").alias("dst")),
        customer.select((6 + F.col("c_nationkey")).cast("long").alias("src"), (31 + F.col("c_custkey")).alias("dst")),
        supplier.crossJoin(F.broadcast(many)).select((6 + F.col("s_nationkey")).cast("long").alias("src"), (31 + F.col("many") + F.col("s_suppkey")).alias("dst")),
    ]
    edges = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    nodes = edges.select(F.col("dst").alias("idx")).unionByName(spark.range(1).select(F.col("id").alias("idx")))
    return graph(nodes, edges.withColumn("eid", F.col("dst") - 1))


def order_tree(spark: SparkSession, sf_dir: str, size: tuple[float, float] = (1000.0, 1000.0)) -> Graph:
    """A tree over the nations: their customers, and these customers' orders; nodes stand on a spiral in order of idx."""
    nation, customer, orders = _tables(spark, sf_dir, "nation", "customer", "orders")
    ends = [t.agg((F.max(c) + 1).cast("long")).first()[0] or 0 for t, c in ((nation, "n_nationkey"), (customer, "c_custkey"), (orders, "o_orderkey"))]
    first, total = (0, ends[0], ends[0] + ends[1]), sum(ends)
    edges = customer.select(F.col("c_nationkey").cast("long").alias("src"), (first[1] + F.col("c_custkey")).alias("dst"))
    edges = edges.unionByName(orders.select((first[1] + F.col("o_custkey")).alias("src"), (first[2] + F.col("o_orderkey")).alias("dst"))).withColumn("eid", F.col("dst"))
    turn, far = F.col("idx") * 2.399963, F.sqrt((F.col("idx") + 0.5) / total)
    nodes = spark.range(total).select(F.col("id").alias("idx"))
    placed = nodes.withColumn("x", size[0] * (0.5 + 0.45 * far * F.cos(turn))).withColumn("y", size[1] * (0.5 + 0.45 * far * F.sin(turn)))
    return graph(placed, edges)
