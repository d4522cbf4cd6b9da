"""Queries over graphs in the test tables, each with the same result in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.functions.numbers import rounded
from vertexloom.operators import (
    descent,
    export,
    force,
    grouping,
    ingest,
    layered,
    metrics,
    multilevel,
    orthogonal,
    planar,
    polygons,
    projection,
    routing,
    similarity,
    spatial,
    static_layouts,
    traversal,
)
from vertexloom.plans.lineage import Rounds, cut, kept, passing
from vertexloom.sources import graphs
from vertexloom.sources.graphs import Graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIZE = (1000.0, 1000.0)

# --- pieces of SQL ---------------------------------------------------------

TRADE3 = """
trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade WHERE src <> dst),
e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, weight, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM top WHERE r <= 3),
nodes AS (SELECT n_nationkey::BIGINT AS idx, n_name AS label FROM nation),
n AS (SELECT count(*) AS n FROM nodes)"""
DAG = TRADE3.replace("\ne AS (", "\ne0 AS (") + ", e AS (SELECT src, dst, weight, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM e0 WHERE src < dst)"
PLACED = TRADE3 + ", p AS (SELECT idx, label, 500 + 450 * cos(2 * pi() * idx / n) AS x, 500 + 450 * sin(2 * pi() * idx / n) AS y FROM nodes, n)"
LINES = PLACED + ", s AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM e JOIN p a ON a.idx = src JOIN p b ON b.idx = dst)"
TRANS = """
after AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
names AS (SELECT event_type AS id, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)),
pairs AS (SELECT s, t, count(*)::DOUBLE AS weight FROM after WHERE t IS NOT NULL GROUP BY 1, 2),
e AS (SELECT a.idx AS src, b.idx AS dst, weight, row_number() OVER (ORDER BY a.idx, b.idx) - 1 AS eid FROM pairs JOIN names a ON a.id = s JOIN names b ON b.id = t),
nodes AS (SELECT idx, id AS label FROM names)"""
HOPS = """
bth AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
walk AS (SELECT idx AS source, idx, 0 AS d FROM nodes UNION SELECT source, dst, d + 1 FROM walk JOIN bth ON src = idx WHERE d < 24),
hops AS (SELECT source, idx, min(d) AS d FROM walk GROUP BY 1, 2)"""
REACH = "reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM reach JOIN e ON src = b)"
CROSS = """
q AS (SELECT a.eid AS e1, b.eid AS e2, a.ax, a.ay, a.ex, a.ey, b.ax AS cx, b.ay AS cy, b.ex AS dx, b.ey AS dy FROM s a JOIN s b ON a.eid < b.eid
  AND a.src NOT IN (b.src, b.dst) AND a.dst NOT IN (b.src, b.dst)),
o AS (SELECT *, sign((ex-ax)*(cy-ay)-(ey-ay)*(cx-ax)) AS t1, sign((ex-ax)*(dy-ay)-(ey-ay)*(dx-ax)) AS t2,
  sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) AS t3, sign((dx-cx)*(ey-cy)-(dy-cy)*(ex-cx)) AS t4 FROM q)"""


def _r(sql: str, digits: int = 6) -> str:
    return f"floor(({sql}) * 1e{digits} + 0.5) / 1e{digits} + 0.0"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _circle(spark: SparkSession, sf_dir: str) -> Graph:
    g = graphs.trade3(spark, sf_dir)
    return g.with_nodes(static_layouts.circular(g, SIZE))


def _xy(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(columns or ("idx",)), rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


# --- edges, degrees, validation --------------------------------------------


@query(
    "edges_canonical",
    f"""
    WITH {TRANS} SELECT arg_min(src, eid) AS src, arg_min(dst, eid) AS dst FROM e WHERE src <> dst GROUP BY
    least(src, dst), greatest(src, dst)
    """,
)
def _(spark, sf_dir):
    return ingest.canonical_edges(graphs.transitions(spark, sf_dir)).select("src", "dst")


for _loop in (1, 2):

    @query(f"degree_loops{_loop}", f"WITH {TRANS} SELECT idx, (SELECT count(*) FROM e WHERE src = idx) + (SELECT count(*) FROM e WHERE dst = idx{' AND src <> dst' if _loop == 1 else ''}) AS degree FROM nodes")
    def _(spark, sf_dir, loop=_loop):
        return ingest.degrees(graphs.transitions(spark, sf_dir), loop).select("idx", "degree")


@query(
    "adjacency",
    f"""
    WITH {TRADE3}, bth AS (SELECT eid, src, dst FROM e UNION ALL SELECT eid, dst, src FROM e)
    SELECT idx, coalesce(list(dst ORDER BY eid, dst) FILTER (dst IS NOT NULL), []) AS neighbours FROM nodes LEFT
    JOIN bth ON src = idx GROUP BY idx
    """,
)
def _(spark, sf_dir):
    return ingest.adjacency(graphs.trade3(spark, sf_dir)).select("idx", "neighbours")


@query(
    "invalid_links",
    f"""
    WITH {TRADE3}, bad AS (SELECT eid, CASE WHEN eid % 10 = 0 THEN NULL WHEN eid % 10 = 1 THEN -1 ELSE src END AS
    src, CASE WHEN eid % 10 = 2 THEN 25 ELSE dst END AS dst FROM e) SELECT eid, CASE WHEN src IS NULL THEN
    'src is null' WHEN src < 0 OR src >= n THEN 'src out of range' ELSE 'dst out of range' END AS problem FROM bad,
    n WHERE src IS NULL OR src < 0 OR src >= n OR dst < 0 OR dst >= n
    """,
)
def _(spark, sf_dir):
    g = graphs.trade3(spark, sf_dir)
    src = F.when(F.col("eid") % 10 == 0, F.lit(None)).when(F.col("eid") % 10 == 1, -1).otherwise(F.col("src"))
    bad = g.edges.withColumn("src", src).withColumn("dst", F.when(F.col("eid") % 10 == 2, 25).otherwise(F.col("dst")))
    return ingest.invalid_links(Graph(g.nodes, bad)).select("eid", "problem")


@query(
    "group_members_invalid",
    """
    SELECT r_regionkey::BIGINT AS gid, 100 + r_regionkey::BIGINT AS member, 'leaf' AS kind FROM region UNION ALL
    SELECT r_regionkey, r_regionkey + 1, 'group' FROM region WHERE r_regionkey + 1 NOT IN (SELECT r_regionkey FROM
    region)
    """,
)
def _(spark, sf_dir):
    g = graphs.trade3(spark, sf_dir)
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    leaves = nation.groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey").cast("long")).alias("own"))
    groups = region.join(leaves, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.lit("g").alias("graph_id"), F.col("r_regionkey").cast("long").alias("gid"), F.concat(F.coalesce("own", F.array().cast("array<long>")), F.array(100 + F.col("r_regionkey").cast("long"))).alias("leaves"), F.array(F.col("r_regionkey").cast("long") + 1).alias("children"))
    return ingest.invalid_groups(groups, g.nodes).select("gid", "member", "kind")


# --- placements ------------------------------------------------------------


@query("circular_trade3", f"WITH {PLACED} SELECT idx, {_r('x')} AS x, {_r('y')} AS y FROM p")
def _(spark, sf_dir):
    return _xy(_circle(spark, sf_dir).nodes)


_DEGREE = "d AS (SELECT idx, (SELECT count(*) FROM e WHERE src = idx) + (SELECT count(*) FROM e WHERE dst = idx) AS degree FROM nodes)"


@query(
    "circular_by_degree",
    f"""
    WITH {TRADE3}, {_DEGREE}, k AS (SELECT idx, row_number() OVER (ORDER BY degree DESC, idx) - 1 AS k FROM d)
    SELECT idx, {_r('500 + 450 * cos(2 * pi() * k / n)')} AS x, {_r('500 + 450 * sin(2 * pi() * k / n)')} AS y FROM
    k, n
    """,
)
def _(spark, sf_dir):
    return _xy(static_layouts.circular(graphs.trade3(spark, sf_dir), SIZE, sort_by="degree"))


@query(
    "shell_auto3",
    f"""
    WITH {TRADE3}, {_DEGREE}, k AS (SELECT idx, row_number() OVER (ORDER BY degree DESC, idx) - 1 AS k FROM d), r AS
    (SELECT idx, k, k * 3 // n AS ring FROM k, n), c AS (SELECT idx, ring, row_number() OVER (PARTITION BY ring
    ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY ring) AS c FROM r) SELECT idx,
    {_r('500 + (ring + 1) * 100.0 * cos(2 * pi() * i / c)')} AS x,
    {_r('500 + (ring + 1) * 100.0 * sin(2 * pi() * i / c)')} AS y FROM c
    """,
)
def _(spark, sf_dir):
    return _xy(static_layouts.shell(graphs.trade3(spark, sf_dir), SIZE, auto=3))


@query(
    "shell_explicit",
    f"""
    WITH {TRADE3}, r AS (SELECT idx, CASE WHEN idx = 7 THEN 0 WHEN idx % 2 = 0 THEN 1 ELSE 2 END AS ring FROM
    nodes), c AS (SELECT idx, ring, row_number() OVER (PARTITION BY ring ORDER BY idx) - 1 AS i, count(*) OVER
    (PARTITION BY ring) AS c FROM r) SELECT idx, {_r('500 + ring * 100.0 * cos(2 * pi() * i / c)')} AS x,
    {_r('500 + ring * 100.0 * sin(2 * pi() * i / c)')} AS y FROM c
    """,
)
def _(spark, sf_dir):
    g = graphs.trade3(spark, sf_dir)
    rings = g.nodes.where("idx = 7 or idx % 2 = 0").select("graph_id", "idx", F.when(F.col("idx") == 7, 0).otherwise(1).alias("ring"), F.col("idx").alias("pos"))
    return _xy(static_layouts.shell(g, SIZE, shells=rings))


_LCG = "((((((idx * 1103515245 + {s}) % 2147483648) * 1103515245 + 12345) % 2147483648) * 214013 + 2531011) % 2147483648) / 2147483648.0::DOUBLE"


@query(
    "random_layout",
    f"""
    WITH {TRADE3} SELECT idx, {_r('50 + ' + _LCG.format(s=7 * 12345) + ' * 900')} AS x, {_r('50 + ' +
    _LCG.format(s=7 * 12345 + 2654435) + ' * 900')} AS y FROM nodes
    """,
)
def _(spark, sf_dir):
    return _xy(static_layouts.random_layout(graphs.trade3(spark, sf_dir), SIZE, margin=50.0, seed=7))


@query(
    "center_graph",
    f"""
    WITH {PLACED}, h AS (SELECT idx, x * 0.5 AS x, y + idx AS y FROM p), b AS (SELECT (min(x) + max(x)) / 2 AS cx,
    (min(y) + max(y)) / 2 AS cy FROM h) SELECT idx, {_r('x + (500 - cx)')} AS x, {_r('y + (500 - cy)')} AS y FROM h,
    b
    """,
)
def _(spark, sf_dir):
    moved = _circle(spark, sf_dir).nodes.withColumn("x", F.col("x") * 0.5).withColumn("y", F.col("y") + F.col("idx"))
    return _xy(static_layouts.centred(moved, SIZE))


def _user_events(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct()
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    user, event = key(0, F.lpad(F.col("user_id").cast("string"), 12, "0")), key(1, F.col("event_type"))
    edges = pairs.select(user.alias("src"), event.alias("dst"))
    g = graphs.densify(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct(), edges)
    return Graph(g.nodes.drop("id"), g.edges)


_USERS = """u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx, count(*) OVER () AS c FROM (SELECT DISTINCT user_id FROM events)),
v AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT event_type FROM events)),
w AS (SELECT idx, idx AS i, c, 0 AS side FROM u UNION ALL SELECT i + (SELECT count(*) FROM u), i, c, 1 FROM v)"""

for _o, _x, _y in (("rows", "400 - (c - 1) * 50.0 / 2 + i * 50.0", "200 + side * 200.0"), ("columns", "300 + side * 200.0", "300 - (c - 1) * 50.0 / 2 + i * 50.0")):

    @query(f"bipartite_{_o}", f"WITH {_USERS} SELECT idx, {_r(_x)} AS x, {_r(_y)} AS y FROM w")
    def _(spark, sf_dir, o=_o):
        return _xy(static_layouts.bipartite(_user_events(spark, sf_dir), orientation="horizontal" if o == "rows" else "vertical", sweeps=0))


@query(
    "barycenter_sweep1",
    """
    WITH ps AS (SELECT DISTINCT l_partkey AS t, l_suppkey AS b FROM lineitem), p AS (SELECT t, row_number() OVER
    (ORDER BY t) - 1 AS pos FROM (SELECT DISTINCT t FROM ps)), m AS (SELECT b, avg(pos) AS mean FROM ps JOIN p USING
    (t) GROUP BY b) SELECT b AS supplier, row_number() OVER (ORDER BY mean, b) - 1 AS pos FROM m
    """,
)
def _(spark, sf_dir):
    pairs = graphs.part_supp(spark, sf_dir)
    parts = pairs.agg((F.max("top") + 1).alias("m")).first().m
    g = Graph(graphs.spark_nodes(pairs, parts), pairs.select(F.lit("g").alias("graph_id"), F.col("top").alias("src"), (F.col("bottom") + parts).alias("dst")).withColumn("eid", F.lit(0).cast("long")))
    side = F.when(F.col("idx") < parts, 0).otherwise(1)
    used = ingest.both_ways(g.edges.select("graph_id", "src", "dst")).select("graph_id", F.col("src").alias("idx")).distinct().withColumn("side", side)
    state = used.withColumn("pos", (F.row_number().over(W.Window.partitionBy("graph_id", "side").orderBy("idx")) - 1).cast("double"))
    out = static_layouts.barycentre_order(g, state, 1).where("side = 1")
    return out.select((F.col("idx") - parts).alias("supplier"), F.col("pos").cast("long").alias("pos"))


@query("radial_geo", f"""WITH leaf AS (SELECT 6 + c_nationkey AS nat, 31 + c_custkey AS idx FROM customer UNION ALL SELECT 6 + s_nationkey, 31 + (SELECT max(c_custkey) + 1 FROM customer) + s_suppkey FROM supplier),
nat AS (SELECT 6 + n_nationkey AS nat, 1 + n_regionkey AS reg, greatest(1, (SELECT count(*) FROM leaf l WHERE l.nat = 6 + n_nationkey)) AS leaves FROM nation),
reg AS (SELECT 1 + r_regionkey AS reg, greatest(1, (SELECT coalesce(sum(leaves), 0) FROM nat WHERE nat.reg = 1 + r_regionkey)) AS leaves FROM region),
root AS (SELECT sum(leaves) AS leaves FROM reg),
r2 AS (SELECT reg, reg.leaves, 2 * pi() * coalesce(sum(reg.leaves) OVER (ORDER BY reg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / root.leaves AS a, 2 * pi() * reg.leaves / root.leaves AS s FROM reg, root),
n2 AS (SELECT nat, nat.leaves, r2.a + r2.s * coalesce(sum(nat.leaves) OVER (PARTITION BY nat.reg ORDER BY nat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / r2.leaves AS a, r2.s * nat.leaves / r2.leaves AS s FROM nat JOIN r2 USING (reg)),
l2 AS (SELECT idx, n2.a + n2.s * (row_number() OVER (PARTITION BY leaf.nat ORDER BY idx) - 1) / n2.leaves AS a, n2.s / n2.leaves AS s FROM leaf JOIN n2 USING (nat)),
every AS (SELECT 0::BIGINT AS idx, 0 AS level, 0.0 AS a, 2 * pi() AS s UNION ALL SELECT reg, 1, a, s FROM r2 UNION ALL SELECT nat, 2, a, s FROM n2 UNION ALL SELECT idx, 3, a, s FROM l2)
SELECT idx, {_r("500 + level * 100.0 * cos(a + s / 2)", 4)} AS x, {_r("500 + level * 100.0 * sin(a + s / 2)", 4)} AS y FROM every""")
def _(spark, sf_dir):
    out = static_layouts.radial_tree(graphs.geo(spark, sf_dir), SIZE)
    return out.select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


# --- metrics ---------------------------------------------------------------


@query("crossings_metric", f"WITH {LINES}, {CROSS} SELECT count(*) AS crossings FROM o WHERE (t1 <> t2 AND t3 <> t4)")
def _(spark, sf_dir):
    return metrics.edge_crossings(_circle(spark, sf_dir)).select("crossings")


@query(
    "crossings_orders",
    """
    WITH c AS (SELECT c_custkey AS k, (c_custkey % 40 * 20)::DOUBLE AS x, (c_custkey // 40 * 20)::DOUBLE AS y FROM customer),
    s AS (SELECT o_orderkey AS eid, k, x AS ax, y AS ay, x + o_orderkey * 37 % 61 - 30 AS ex, y + o_orderkey * 53 % 59 - 29 AS ey FROM orders JOIN c ON o_custkey = k),
    q AS (SELECT a.ax, a.ay, a.ex, a.ey, b.ax AS cx, b.ay AS cy, b.ex AS dx, b.ey AS dy FROM s a JOIN s b ON a.eid < b.eid AND a.k <> b.k
      AND greatest(a.ax, a.ex) >= least(b.ax, b.ex) AND greatest(b.ax, b.ex) >= least(a.ax, a.ex) AND greatest(a.ay, a.ey) >= least(b.ay, b.ey) AND greatest(b.ay, b.ey) >= least(a.ay, a.ey)),
    o AS (SELECT sign((ex-ax)*(cy-ay)-(ey-ay)*(cx-ax)) AS t1, sign((ex-ax)*(dy-ay)-(ey-ay)*(dx-ax)) AS t2, sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) AS t3, sign((dx-cx)*(ey-cy)-(dy-cy)*(ex-cx)) AS t4 FROM q)
    SELECT count(*) AS crossings FROM o WHERE t1 * t2 < 0 AND t3 * t4 < 0
    """,
)
def _(spark, sf_dir):
    """Crossings inside both of edges from customers, who stand in rows of 40, to their orders, some way off."""
    tree = graphs.order_tree(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").agg((F.max("c_custkey") + 1).alias("n")).first().n or 0
    first = spark.read.parquet(f"{sf_dir}/nation.parquet").agg((F.max("n_nationkey") + 1).alias("n")).first().n or 0
    k, o = F.col("idx") - first, F.col("idx") - first - customers
    owned = tree.edges.where(F.col("src") >= first)
    of = owned.select("graph_id", F.col("dst").alias("idx"), (F.col("src") - first).alias("k"))
    nodes = tree.nodes.join(of, ["graph_id", "idx"], "left").withColumn("k", F.coalesce("k", k))
    order = F.col("idx") >= first + customers
    x = F.col("k") % 40 * 20 + F.when(order, o * 37 % 61 - 30).otherwise(0)
    y = F.floor(F.col("k") / 40) * 20 + F.when(order, o * 53 % 59 - 29).otherwise(0)
    g = Graph(nodes.withColumn("x", x.cast("double")).withColumn("y", y.cast("double")).drop("k"), owned)
    return metrics.crossing_points(g).agg(F.count("*").alias("crossings"))


@query("crossings_strict", f"WITH {LINES}, {CROSS} SELECT count(*) AS crossings FROM o WHERE t1 * t2 < 0 AND t3 * t4 < 0")
def _(spark, sf_dir):
    return metrics.crossing_points(_circle(spark, sf_dir)).agg(F.count("*").alias("crossings"))


@query(
    "crossing_points",
    f"""
    WITH {LINES}, {CROSS}, t AS (SELECT *, ((cx-ax)*(dy-cy)-(cy-ay)*(dx-cx)) / ((ex-ax)*(dy-cy)-(ey-ay)*(dx-cx)) AS
    t FROM o WHERE t1 * t2 < 0 AND t3 * t4 < 0) SELECT e1, e2, {_r('ax + t * (ex - ax)', 4)} AS x,
    {_r('ay + t * (ey - ay)', 4)} AS y FROM t
    """,
)
def _(spark, sf_dir):
    return metrics.crossing_points(_circle(spark, sf_dir)).select("e1", "e2", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


_LEN = "l AS (SELECT eid, sqrt((ax-ex)*(ax-ex) + (ay-ey)*(ay-ey)) AS l FROM s)"


@query("edge_lengths", f"WITH {LINES}, {_LEN} SELECT eid, {_r('l')} AS length FROM l")
def _(spark, sf_dir):
    return metrics.edge_lengths(_circle(spark, sf_dir)).select("eid", rounded(F.col("length")).alias("length"))


_ANGLE = """bth AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
dir AS (SELECT src, dst, degrees(atan2(b.y - a.y, b.x - a.x)) AS t FROM bth JOIN p a ON a.idx = src JOIN p b ON b.idx = dst),
gap AS (SELECT coalesce(lead(t) OVER (PARTITION BY src ORDER BY t, dst), first_value(t) OVER (PARTITION BY src ORDER BY t, dst) + 360) - t AS g, count(*) OVER (PARTITION BY src) AS c FROM dir),
ang AS (SELECT coalesce(min(CASE WHEN g <= 0 THEN g + 360 ELSE g END), 360.0) AS angle FROM gap WHERE c > 1)"""


@query("angular_resolution", f"WITH {LINES}, {_ANGLE} SELECT {_r('angle')} AS angle FROM ang")
def _(spark, sf_dir):
    return metrics.angular_resolution(_circle(spark, sf_dir)).select(rounded(F.col("angle")).alias("angle"))


@query(
    "quality_trade3",
    f"""
    WITH {LINES}, {CROSS}, {_LEN}, {_ANGLE}, m AS (SELECT var_pop(l) AS v, 1 - stddev_pop(l) / avg(l) AS u FROM l)
    SELECT (SELECT count(*) FROM o WHERE t1 <> t2 AND t3 <> t4) AS crossings, {_r('v', 4)} AS variance,
    {_r('greatest(0, least(1, u))')} AS uniformity, {_r('angle')} AS angle FROM m, ang
    """,
)
def quality_trade3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a circular drawing of trade between nations, and its quality in one row."""
    q = metrics.quality_summary(_circle(spark, sf_dir), with_stress=False)
    return q.select("crossings", rounded(F.col("variance"), 4).alias("variance"), rounded(F.col("uniformity")).alias("uniformity"), rounded(F.col("angle")).alias("angle"))


@query(
    "stress_hop",
    f"""
    WITH RECURSIVE {PLACED}, {HOPS}, w AS (SELECT h.d * 100.0 AS d, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))
    AS l FROM hops h JOIN p a ON a.idx = h.source JOIN p b ON b.idx = h.idx WHERE h.source < h.idx AND h.d > 0)
    SELECT {_r('sum((l - d) * (l - d) / (d * d)) / count(*)')} AS stress FROM w
    """,
)
def _(spark, sf_dir):
    return metrics.stress(_circle(spark, sf_dir), hops=True).select(rounded(F.col("stress")).alias("stress"))


@query(
    "quadtree_masses",
    f"""
    WITH {PLACED}, b AS (SELECT (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my, greatest(max(x)-min(x),
    max(y)-min(y))/2 + 10 AS h FROM p), c AS (SELECT x, y, least(7, floor((x-mx+h)/(2*h)*8))::INT AS cx, least(7,
    floor((y-my+h)/(2*h)*8))::INT AS cy FROM p, b), l AS (SELECT unnest([0, 1, 2, 3]) AS level)
    SELECT level, cx >> (3 - level) AS cx, cy >> (3 - level) AS cy, count(*)::DOUBLE AS mass, {_r('avg(x)', 4)} AS
    x, {_r('avg(y)', 4)} AS y FROM c, l GROUP BY 1, 2, 3
    """,
)
def _(spark, sf_dir):
    out = spatial.cell_pyramid(_circle(spark, sf_dir).nodes, levels=4)
    return out.select("level", "cx", "cy", "mass", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


# --- structure -------------------------------------------------------------


@query("components", "SELECT c_custkey AS idx, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer")
def _(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    chain = customer.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(W.Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")).alias("dst")).where("dst is not null")
    return traversal.components(graphs.graph(customer.select(F.col("c_custkey").alias("idx")), chain.withColumn("eid", F.col("src")))).select("idx", "component")


@query(
    "is_connected",
    """
    SELECT 'nation ' || c_nationkey AS graph_id, count(DISTINCT c_mktsegment) <= 1 AS connected FROM customer GROUP BY 1
    UNION ALL SELECT 'region ' || r_regionkey, true FROM region
    """,
)
def _(spark, sf_dir):
    return traversal.is_connected(graphs.customer_chains(spark, sf_dir))


@query(
    "bfs_layers",
    """
    SELECT 0::BIGINT AS layer, 1::BIGINT AS nodes UNION ALL SELECT 1, count(*) FROM region UNION ALL
    SELECT 2, count(*) FROM nation UNION ALL SELECT 3, (SELECT count(*) FROM customer) + (SELECT count(*) FROM
    supplier)
    """,
)
def _(spark, sf_dir):
    return traversal.bfs_layers(graphs.geo(spark, sf_dir)).groupBy("layer").agg(F.count("*").alias("nodes"))


@query("apsp_hops", f"WITH RECURSIVE {TRADE3}, {HOPS} SELECT source, idx, d::DOUBLE AS dist FROM hops")
def _(spark, sf_dir):
    return traversal.all_pairs(graphs.trade3(spark, sf_dir)).select("source", "idx", "dist")


@query(
    "sssp_weighted",
    f"""
    WITH RECURSIVE {TRADE3}, c AS (SELECT src, dst, 1 + eid % 5 AS w FROM e UNION ALL
    SELECT dst, src, 1 + eid % 5 FROM e), walk AS (SELECT 0::BIGINT AS idx, 0 AS d UNION
    SELECT dst, d + w FROM walk JOIN c ON src = idx WHERE d + w <= 40) SELECT idx, min(d)::DOUBLE AS dist FROM walk
    GROUP BY idx
    """,
)
def _(spark, sf_dir):
    g = graphs.trade3(spark, sf_dir)
    weighed = Graph(g.nodes, g.edges.withColumn("length", (1 + F.col("eid") % 5).cast("double")))
    return traversal.distances(weighed, spark.createDataFrame([("g", 0)], "graph_id string, source long"), "length").select("idx", "dist")


@query(
    "turn_paths",
    f"""
    WITH RECURSIVE {TRADE3}, c AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, 1 + eid % 5 AS w FROM e UNION ALL SELECT dst, src, 1 + eid % 5 FROM e) GROUP BY 1, 2),
    walk AS (SELECT src AS a, dst AS b, w AS d FROM c WHERE src = 0 UNION SELECT b, dst, d + w + (a + 2 * b + 3 * dst) % 4 FROM walk JOIN c ON src = b WHERE d + w + (a + 2 * b + 3 * dst) % 4 <= 40)
    SELECT b AS target, min(d)::DOUBLE AS dist FROM walk WHERE b <> 0 GROUP BY b UNION ALL SELECT 0, 0.0
    """,
)
def _(spark, sf_dir):
    """Least costs from nation 0 where each turn costs 0 to 3 besides the edges."""
    g = graphs.trade3(spark, sf_dir)
    weighed = Graph(g.nodes, g.edges.withColumn("length", (1 + F.col("eid") % 5).cast("double"))).settled()
    asked = weighed.nodes.select("graph_id", F.lit(0).alias("source"), F.col("idx").alias("target"))
    return traversal.paths_with_turns(weighed, asked, lambda a, b, c: (a + 2 * b + 3 * c) % 4, "length").select("target", "dist")


@query(
    "longest_path_layers",
    f"""
    WITH RECURSIVE {DAG}, walk AS (SELECT idx, 0::BIGINT AS d FROM nodes WHERE idx NOT IN (SELECT dst FROM e) UNION
    SELECT dst, d + 1 FROM walk JOIN e ON src = idx) SELECT idx, max(d) AS layer FROM walk GROUP BY idx
    """,
)
def _(spark, sf_dir):
    return traversal.longest_path_layers(graphs.dag(spark, sf_dir)).select("idx", "layer")


@query(
    "topo_levels",
    f"""
    WITH RECURSIVE {DAG}, walk AS (SELECT idx, 0::BIGINT AS d FROM nodes UNION
    SELECT dst, d + 1 FROM walk JOIN e ON src = idx), l AS (SELECT idx, max(d) AS level FROM walk GROUP BY idx)
    SELECT idx, level, row_number() OVER (ORDER BY level, idx) - 1 AS pos FROM l
    """,
)
def _(spark, sf_dir):
    g = graphs.dag(spark, sf_dir)
    return traversal.peel(g).join(traversal.topological_order(g), ["graph_id", "idx"]).select("idx", "level", "pos")


@query("has_cycle", f"WITH RECURSIVE {TRADE3}, {REACH} SELECT bool_or(a = b) AS has_cycle FROM reach")
def _(spark, sf_dir):
    return traversal.has_cycle(graphs.trade3(spark, sf_dir)).select("has_cycle")


@query(
    "scc",
    f"""
    WITH RECURSIVE {TRADE3}, {REACH} SELECT idx, least(idx, coalesce((SELECT min(r.b) FROM reach r JOIN reach q ON
    q.a = r.b AND q.b = r.a WHERE r.a = idx), idx)) AS component FROM nodes
    """,
)
def _(spark, sf_dir):
    return traversal.strong_components(graphs.trade3(spark, sf_dir)).select("idx", "component")


@query("bipartite_check", f"WITH {_USERS} SELECT idx, side, true AS bipartite FROM w")
def _(spark, sf_dir):
    return traversal.two_colouring(_user_events(spark, sf_dir)).select("idx", "side", "bipartite")


_NBR = """
bth AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nb AS (SELECT src AS v, list(DISTINCT dst) AS l
FROM bth GROUP BY src), c AS (SELECT eid, len(a.l) AS nu, len(b.l) AS nv, len(list_intersect(a.l, b.l)) AS s
FROM e JOIN nb a ON a.v = src JOIN nb b ON b.v = dst)"""


@query(
    "sim_lengths_jaccard",
    f"""
    WITH {TRADE3}, {_NBR} SELECT eid, {_r('1 + CASE WHEN least(nu, nv) < 1.1 THEN 0 ELSE s / (nu + nv - s) END')} AS
    length FROM c
    """,
)
def _(spark, sf_dir):
    return similarity.jaccard_lengths(graphs.trade3(spark, sf_dir)).select("eid", rounded(F.col("length")).alias("length"))


@query("sim_lengths_symdiff", f"WITH {TRADE3}, {_NBR} SELECT eid, {_r('1 + sqrt(nu + nv - 2 * s)')} AS length FROM c")
def _(spark, sf_dir):
    return similarity.symmetric_difference_lengths(graphs.trade3(spark, sf_dir)).select("eid", rounded(F.col("length")).alias("length"))


@query(
    "sep_constraints",
    f"""
    WITH RECURSIVE {TRADE3}, {REACH} SELECT 'y' AS axis, src AS "left", dst AS "right", 30.0::DOUBLE AS gap FROM e
    WHERE NOT EXISTS (SELECT 1 FROM reach WHERE a = dst AND b = src)
    """,
)
def _(spark, sf_dir):
    return similarity.separation_constraints(graphs.trade3(spark, sf_dir), gap=30.0).select("axis", "left", "right", "gap")


# --- layers ----------------------------------------------------------------


@query(
    "bilayer_crossings",
    """
    WITH c AS (SELECT DISTINCT l_partkey AS t, l_suppkey AS b FROM lineitem),
    grid AS (SELECT t.t, b.b, (c.t IS NOT NULL)::BIGINT AS c FROM (SELECT DISTINCT t FROM c) t CROSS JOIN (SELECT DISTINCT b FROM c) b LEFT JOIN c ON c.t = t.t AND c.b = b.b),
    r AS (SELECT *, sum(c) OVER (PARTITION BY t ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond FROM grid),
    s AS (SELECT c, sum(coalesce(beyond, 0)) OVER (PARTITION BY b ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM r)
    SELECT coalesce(sum(c * coalesce(over, 0)), 0)::BIGINT AS crossings FROM s
    """,
)
def _(spark, sf_dir):
    return layered.bilayer_crossings(graphs.part_supp(spark, sf_dir))


_LAYER = """
walk AS (SELECT idx, 0::BIGINT AS d FROM nodes UNION SELECT dst, d + 1 FROM walk JOIN e ON src = idx), ly AS
(SELECT idx, max(d) AS layer FROM walk GROUP BY idx)"""


@query(
    "dummy_nodes",
    f"""
    WITH RECURSIVE {DAG}, {_LAYER}, x AS (SELECT eid, unnest(range(a.layer + 1, b.layer)) AS layer FROM e JOIN ly a
    ON a.idx = src JOIN ly b ON b.idx = dst) SELECT eid, layer, n + row_number() OVER (ORDER BY eid, layer) - 1 AS
    dummy FROM x, n
    """,
)
def _(spark, sf_dir):
    g = graphs.dag(spark, sf_dir)
    return layered.dummy_nodes(g, traversal.longest_path_layers(g)).select("eid", "layer", "dummy")


@query(
    "layered_crossings",
    f"""
    WITH RECURSIVE {DAG}, {_LAYER}, p AS (SELECT idx, layer::DOUBLE AS y, (row_number() OVER (PARTITION BY layer
    ORDER BY idx) - 1)::DOUBLE AS x FROM ly), s AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM e
    JOIN p a ON a.idx = src JOIN p b ON b.idx = dst), {CROSS} SELECT count(*) AS crossings FROM o WHERE t1 * t2 < 0
    AND t3 * t4 < 0
    """,
)
def _(spark, sf_dir):
    g = graphs.dag(spark, sf_dir)
    return layered.layered_crossings(g, layered.positions(traversal.longest_path_layers(g))).select("crossings")


@query("layered_dag")
def _(spark, sf_dir):
    return layered.layered(graphs.dag(spark, sf_dir)).select("idx", "x", "y")


# --- forces ----------------------------------------------------------------

_PAIR = """
pr AS (SELECT a.idx, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d,
b.idx AS j FROM p a JOIN p b ON a.idx <> b.idx)"""
_PULL = """
pl AS (SELECT eid, src, dst, weight, ex - ax AS dx, ey - ay AS dy, sqrt((ax-ex)*(ax-ex) + (ay-ey)*(ay-ey)) AS d
FROM s), bth AS (SELECT src AS idx, dx, dy, d, weight FROM pl UNION ALL
SELECT dst, -dx, -dy, d, weight FROM pl)"""


def _sum_forces(pair: str, pull: str, gx: str, gy: str) -> str:
    return f"f AS (SELECT p.idx, p.x, p.y, (SELECT sum(dx / d * ({pair})) FROM pr WHERE pr.idx = p.idx) + coalesce((SELECT sum(dx / d * ({pull})) FROM bth b WHERE b.idx = p.idx), 0) + ({gx}) AS fx, (SELECT sum(dy / d * ({pair})) FROM pr WHERE pr.idx = p.idx) + coalesce((SELECT sum(dy / d * ({pull})) FROM bth b WHERE b.idx = p.idx), 0) + ({gy}) AS fy FROM p)"


@query(
    "fr_tick1",
    f"""
    WITH {LINES}, {_PAIR}, {_PULL}, {_sum_forces('40000.0 / d', 'd * d / 200.0', '0.1 * (500 - p.x)',
    '0.1 * (500 - p.y)')}, m AS (SELECT *, sqrt(fx*fx + fy*fy) AS f FROM f)
    SELECT idx, {_r('greatest(0, least(1000, x + fx * least(f, 100) / f))', 4)} AS x,
    {_r('greatest(0, least(1000, y + fy * least(f, 100) / f))', 4)} AS y FROM m
    """,
)
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.fruchterman_reingold_tick(g, g.nodes, SIZE).select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


@query(
    "spring_tick1",
    f"""
    WITH {LINES}, {_PAIR}, {_PULL}, {_sum_forces('10000.0 / (d * d)', '0.1 * (d - 100.0)', '0', '0')}
    SELECT idx, {_r('x + fx * 0.5', 4)} AS x, {_r('y + fy * 0.5', 4)} AS y FROM f
    """,
)
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.spring_tick(g, g.nodes, SIZE).select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


@query(
    "fa2_tick1",
    f"""
    WITH {LINES}, {_DEGREE}, {_PAIR.replace('b.idx AS j FROM',
    '2.0 * (da.degree + 1) * (db.degree + 1) AS q FROM').replace('a.idx <> b.idx',
    'a.idx <> b.idx JOIN d da ON da.idx = a.idx JOIN d db ON db.idx = b.idx')}, {_PULL}, c AS (SELECT p.idx, degree
    + 1.0 AS m, sqrt((500-x)*(500-x) + (500-y)*(500-y)) AS r FROM p JOIN d USING (idx)), {_sum_forces('q / d',
    'weight * d', '(500 - p.x) * (SELECT m / r FROM c WHERE c.idx = p.idx)',
    '(500 - p.y) * (SELECT m / r FROM c WHERE c.idx = p.idx)')}, g AS (SELECT f.*, m, sqrt(fx*fx + fy*fy) AS z FROM
    f JOIN c USING (idx)), v AS (SELECT sum(m * z / 2) / greatest(sum(m * z), 1e-9) AS v FROM g)
    SELECT idx, {_r('x + fx * least(v / (1 + v * sqrt(z)), 10 / z)', 4)} AS x,
    {_r('y + fy * least(v / (1 + v * sqrt(z)), 10 / z)', 4)} AS y FROM g, v
    """,
)
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.force_atlas2_tick(g, g.nodes, SIZE).select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


_IDEAL = """
w AS (SELECT h.source AS i, h.idx AS j, h.d * 100.0 AS d, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj,
sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS l FROM hops h JOIN p a ON a.idx = h.source JOIN p b ON b.idx
= h.idx WHERE h.source <> h.idx)"""


@query(
    "kk_gradient",
    f"""
    WITH RECURSIVE {PLACED}, {HOPS}, {_IDEAL} SELECT i AS idx, {_r('sum((xi - xj) * (1 - d / l) / (d * d))', 8)} AS
    gx, {_r('sum((yi - yj) * (1 - d / l) / (d * d))', 8)} AS gy FROM w GROUP BY i
    """,
)
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.spring_gradient(g.nodes, force._ideal(g, 100.0, None)).select("idx", rounded(F.col("gx"), 8).alias("gx"), rounded(F.col("gy"), 8).alias("gy"))


@query("kk_tick1", f"""WITH RECURSIVE {PLACED}, {HOPS}, {_IDEAL},
h AS (SELECT i, sum((1 - d / l) * (xi - xj) / (d * d)) AS gx, sum((1 - d / l) * (yi - yj) / (d * d)) AS gy, sum((1 - d * (yi - yj) * (yi - yj) / (l * l * l)) / (d * d)) AS hxx,
  sum((1 - d * (xi - xj) * (xi - xj) / (l * l * l)) / (d * d)) AS hyy, sum((xi - xj) * (yi - yj) / (l * l * l) / d) AS hxy FROM w GROUP BY i),
m AS (SELECT * FROM h ORDER BY sqrt(gx * gx + gy * gy) DESC, i LIMIT 1)
SELECT idx, {_r('x + coalesce((hxy * gy - hyy * gx) / (hxx * hyy - hxy * hxy), 0)', 4)} AS x, {_r('y + coalesce((hxy * gx - hxx * gy) / (hxx * hyy - hxy * hxy), 0)', 4)} AS y FROM p LEFT JOIN m ON i = idx""")
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.kamada_kawai_tick(g.nodes, force._ideal(g, 100.0, None)).select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


@query(
    "smacof_step1",
    f"""
    WITH RECURSIVE {PLACED}, {HOPS}, {_IDEAL} SELECT i AS idx,
    {_r('sum((xj + d / l * (xi - xj)) / (d * d)) / sum(1 / (d * d))', 4)} AS x,
    {_r('sum((yj + d / l * (yi - yj)) / (d * d)) / sum(1 / (d * d))', 4)} AS y FROM w GROUP BY i
    """,
)
def _(spark, sf_dir):
    g = _circle(spark, sf_dir)
    return force.stress_step(g.nodes, force._ideal(g, 100.0, None)).select("idx", rounded(F.col("x"), 4).alias("x"), rounded(F.col("y"), 4).alias("y"))


def _ticks_sql(start: str, more: str, repulsion: str, attraction: str, centre: tuple[str, str], rule: str, ticks: int) -> str:
    """Ticks as a chain of tables p0, p1 ...; `rule` gives what a tick's forces make of a node (g: forces fx, fy, z; k: the tick)."""
    out = [f"p0 AS MATERIALIZED ({start})"]
    for k in range(ticks):
        out.append(f"""
    away{k} AS MATERIALIZED (SELECT idx, sum(dx / d * ({repulsion})) AS fx, sum(dy / d * ({repulsion})) AS fy FROM (
      SELECT a.idx, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d, a.m * b.m AS q FROM p{k} a JOIN p{k} b ON a.idx <> b.idx)
      WHERE d > 0.01 GROUP BY idx),
    pull{k} AS MATERIALIZED (SELECT idx, sum(dx / d * ({attraction})) AS fx, sum(dy / d * ({attraction})) AS fy FROM (
      SELECT a.idx, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d, weight
      FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) JOIN p{k} a ON a.idx = src JOIN p{k} b ON b.idx = dst) WHERE d > 0.01 GROUP BY idx),
    f{k} AS MATERIALIZED (SELECT p.*, coalesce(a.fx, 0) + coalesce(b.fx, 0) + ({centre[0]}) AS fx, coalesce(a.fy, 0) + coalesce(b.fy, 0) + ({centre[1]}) AS fy
      FROM p{k} p LEFT JOIN away{k} a USING (idx) LEFT JOIN pull{k} b USING (idx)),
    g{k} AS MATERIALIZED (SELECT *, sqrt(fx*fx + fy*fy) AS z{more} FROM f{k}), {rule.format(k=k, n=k + 1)}""")
    return ", ".join(out)


_FA2 = _ticks_sql(
    "SELECT p.idx, x, y, degree + 1.0 AS m, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 1.0::DOUBLE AS speed FROM p JOIN d USING (idx)",
    ", sqrt((fx-px)*(fx-px) + (fy-py)*(fy-py)) AS sw, sqrt((fx+px)*(fx+px) + (fy+py)*(fy+py)) / 2 AS dr",
    "2.0 * q / d", "weight * d",
    ("(500 - p.x) * m / sqrt((500-p.x)*(500-p.x) + (500-p.y)*(500-p.y))", "(500 - p.y) * m / sqrt((500-p.x)*(500-p.x) + (500-p.y)*(500-p.y))"),
    """v{k} AS MATERIALIZED (SELECT least(sum(m * dr) / sum(m * sw), 1.5 * max(speed)) AS v FROM g{k}),
    h{k} AS MATERIALIZED (SELECT *, CASE WHEN z >= 0.01 THEN least(v / (1 + v * sqrt(sw)), 10 / z) ELSE 0 END AS s FROM g{k}, v{k}),
    p{n} AS MATERIALIZED (SELECT idx, x + fx * s AS x, y + fy * s AS y, m, fx AS px, fy AS py, v AS speed FROM h{k})""", 3,
)
_HU = lambda ticks: _ticks_sql(
    "SELECT idx, x, y, 1.0::DOUBLE AS m, 20.0::DOUBLE AS step, 'inf'::DOUBLE AS energy, 0 AS falls FROM p", "", "8000.0 / d", "d * d / 200.0", ("0", "0"),
    """e{k} AS MATERIALIZED (SELECT sum(z * z) AS now FROM g{k}),
    c{k} AS MATERIALIZED (SELECT *, CASE WHEN now < energy THEN falls + 1 ELSE 0 END AS fell FROM g{k}, e{k}),
    s{k} AS MATERIALIZED (SELECT *, CASE WHEN fell >= 5 THEN step / 0.9 WHEN now >= energy THEN step * 0.9 ELSE step END AS new FROM c{k}),
    p{n} AS MATERIALIZED (SELECT idx, x + fx * least(z, new) / z AS x, y + fy * least(z, new) / z AS y, m, new AS step, now AS energy, CASE WHEN fell >= 5 THEN 0 ELSE fell END AS falls FROM s{k})""", ticks,
)


@query("fa2_tick3", f"WITH {LINES}, {_DEGREE}, {_FA2} SELECT idx, {_r('x', 4)} AS x, {_r('y', 4)} AS y, {_r('speed', 8)} AS speed FROM p3")
def _(spark, sf_dir):
    g = _circle(spark, sf_dir).settled()
    state = g.nodes
    for _ in range(3):
        state = cut(force.force_atlas2_tick(g, state, SIZE))
    return _xy(state, "idx", rounded(F.col("speed"), 8).alias("speed")).select("idx", *_near(), "speed")


def _near() -> list:
    return [rounded(F.col(c), 4).alias(c) for c in ("x", "y")]


for _n in (1, 8):

    @query(f"yifan_hu_tick{_n}", f"WITH {LINES}, {_HU(_n)} SELECT idx, {_r('x', 4)} AS x, {_r('y', 4)} AS y, {_r('step')} AS step FROM p{_n}")
    def _(spark, sf_dir, n=_n):
        g = _circle(spark, sf_dir).settled()
        state = g.nodes
        for _ in range(n):
            state = cut(force.yifan_hu_tick(g, state, SIZE))
        return state.select("idx", *_near(), rounded(F.col("step")).alias("step"))


@query("far_forces_orders")
def _(spark, sf_dir):
    """Repulsion between all of some 10^5 nodes (at sf0.1) by interaction lists."""
    g = graphs.order_tree(spark, sf_dir)
    return spatial.interaction_forces(g.nodes, 1.0, 1.0).select("idx", "fx", "fy")


@query("yifan_hu_orders")
def _(spark, sf_dir):
    """The energy and step of four ticks on the tree of nations, customers and orders, by interaction lists."""
    g = graphs.order_tree(spark, sf_dir)
    g = Graph(kept(g.nodes), kept(g.edges))
    state, seen, keep = g.nodes, None, Rounds(spark)
    for t in range(4):
        state = passing(spark, lambda now=state: force.yifan_hu_tick(g, now, SIZE, leaf=spatial.LEAF), keep)
        one = cut(state.groupBy("graph_id").agg(F.lit(t + 1).alias("tick"), F.max("energy").alias("energy"), F.max("step").alias("step"), F.count("*").alias("nodes")))
        seen = one if seen is None else seen.unionByName(one)
    return seen.drop("graph_id")


# --- descent and constraints -----------------------------------------------

_GOALS = """ideal AS MATERIALIZED (SELECT h.source AS i, h.idx AS j, h.d * 100.0 AS d,
  CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = h.source AND dst = h.idx OR src = h.idx AND dst = h.source) THEN 1 ELSE 2 END AS goal FROM hops h WHERE h.source <> h.idx)"""


def _stage_sql(p: str, out: str) -> str:
    """The table `out`: table p one step of descent on."""
    return f"""
    t_{out} AS MATERIALIZED (SELECT i, j, dx, dy, 2 * (l - d) / (d * d * l) AS pull, -2 / (d*d*l*l*l) * (2*l*l*l + d * (dx*dx - l*l)) AS hx, -2 / (d*d*l*l*l) * (2*l*l*l + d * (dy*dy - l*l)) AS hy
      FROM (SELECT i, j, d, goal, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS l FROM ideal JOIN {p} a ON a.idx = i JOIN {p} b ON b.idx = j)
      WHERE l > 0 AND NOT (goal > 1 AND l > d)),
    g_{out} AS MATERIALIZED (SELECT idx, coalesce(sum(dx * pull), 0) AS gx, coalesce(sum(dy * pull), 0) AS gy FROM {p} LEFT JOIN t_{out} ON i = idx GROUP BY idx),
    s_{out} AS MATERIALIZED (SELECT (SELECT sum(gx*gx + gy*gy) FROM g_{out}) / (SELECT sum(-0.5 * (hx * (a.gx-b.gx)*(a.gx-b.gx) + hy * (a.gy-b.gy)*(a.gy-b.gy)))
      FROM t_{out} JOIN g_{out} a ON a.idx = i JOIN g_{out} b ON b.idx = j) AS step),
    {out} AS MATERIALIZED (SELECT idx, x - step * gx AS x, y - step * gy AS y FROM {p} JOIN g_{out} USING (idx), s_{out})"""


def _halfway_sql(p: str, q: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT idx, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM {p} a JOIN {q} b USING (idx))"


_STAGES = ", ".join((_stage_sql("p", "ka"), _halfway_sql("p", "ka", "ha"), _stage_sql("ha", "kb"), _halfway_sql("p", "kb", "hb"), _stage_sql("hb", "kc"), _stage_sql("kc", "kd")))


def _unweighted(spark: SparkSession, sf_dir: str) -> Graph:
    g = _circle(spark, sf_dir)
    return Graph(g.nodes, g.edges.withColumn("weight", F.lit(None).cast("double"))).settled()


@query("descent_step1", f"WITH RECURSIVE {PLACED}, {HOPS}, {_GOALS}, {_stage_sql('p', 'q')} SELECT idx, {_r('x', 4)} AS x, {_r('y', 4)} AS y FROM q")
def _(spark, sf_dir):
    g = _unweighted(spark, sf_dir)
    return descent.next_position(g.nodes, cut(descent.ideal_distances(g))).select("idx", *_near())


@query(
    "descent_runge_kutta1",
    f"""
    WITH RECURSIVE {PLACED}, {HOPS}, {_GOALS}, {_STAGES}
    SELECT idx, {_r('(ka.x + 2 * kb.x + 2 * kc.x + kd.x) / 6', 4)} AS x, {_r('(ka.y + 2 * kb.y + 2 * kc.y + kd.y) / 6', 4)} AS y
    FROM ka JOIN kb USING (idx) JOIN kc USING (idx) JOIN kd USING (idx)
    """,
)
def _(spark, sf_dir):
    g = _unweighted(spark, sf_dir)
    return descent.runge_kutta(g.nodes, cut(descent.ideal_distances(g))).select("idx", *_near())


@query("projected_dag", f"WITH {DAG} SELECT src AS \"left\", dst AS \"right\", 30.0::DOUBLE AS gap, true AS met FROM e")
def _(spark, sf_dir):
    """The nations' ranks (y), moved to let every edge go down by 30: 20 rounds of prices, and longest paths for the rest."""
    g = graphs.dag(spark, sf_dir).settled()
    nodes = g.nodes.withColumn("y", (F.col("idx") * 37 % 101).cast("double"))
    rules = g.edges.select("graph_id", F.col("src").alias("left"), F.col("dst").alias("right"), F.lit(30.0).alias("gap"))
    placed = projection.project(nodes, rules, "y", rounds=20, nearest=False).select("graph_id", "idx", F.col("y").alias("p"))
    return projection._ends(rules, placed).select("left", "right", "gap", (F.col("pr") - F.col("pl") >= F.col("gap") - 1e-6).alias("met"))


@query(
    "projected_stars",
    f"""
    WITH c AS (SELECT s_nationkey AS n, s_suppkey AS idx, round(s_acctbal / 100) AS y, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS hub FROM supplier),
    z AS (SELECT n, idx, y - 9.0 AS z, row_number() OVER (PARTITION BY n ORDER BY y, idx) AS k FROM c WHERE idx <> hub),
    s AS (SELECT n, k, sum(z) OVER (PARTITION BY n ORDER BY k) AS sum FROM z),
    h AS (SELECT c.n, c.idx, least(c.y, coalesce(min((c.y + s.sum) / (s.k + 1)), c.y)) AS x FROM c LEFT JOIN s ON s.n = c.n WHERE c.idx = hub GROUP BY c.n, c.idx, c.y)
    SELECT 'nation ' || n AS graph_id, idx, {_r('x', 3)} AS x FROM h UNION ALL
    SELECT 'nation ' || z.n, z.idx, {_r('greatest(z.z, h.x) + 9.0', 3)} FROM z JOIN h ON h.n = z.n
    """,
)
def _(spark, sf_dir):
    """Each nation's suppliers at least 9 to the right of its first one, as near to their balances (in hundreds) as can be."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("graph_id"), F.col("s_suppkey").alias("idx"), F.round(F.col("s_acctbal") / 100).alias("x"))
    hub = own.groupBy("graph_id").agg(F.min("idx").alias("left"))
    rules = own.join(hub, "graph_id").where("idx <> left").select("graph_id", "left", F.col("idx").alias("right"), F.lit(9.0).alias("gap"))
    return projection.project(own, rules, "x", tolerance=2e-5).select("graph_id", "idx", rounded(F.col("x"), 3).alias("x"))


@query(
    "aligned_regions",
    f"""
    WITH p AS (SELECT n_nationkey::BIGINT AS idx, n_regionkey AS r, (n_nationkey * 37 % 101)::DOUBLE AS x, n_nationkey * 2.0::DOUBLE AS o FROM nation)
    SELECT idx, {_r('avg(x - o) OVER (PARTITION BY r) + o')} AS x FROM p
    """,
)
def _(spark, sf_dir):
    """The nations of a region on one line, each with its own offset to it."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    own = nation.select(F.lit("g").alias("graph_id"), F.col("n_nationkey").cast("long").alias("idx"), F.col("n_regionkey").alias("aid"), (F.col("n_nationkey") * 37 % 101).cast("double").alias("x"))
    lines = projection.alignments(own.select("graph_id", "aid", "idx", (F.col("idx") * 2.0).alias("offset")))
    return projection.project(own.drop("aid"), lines, "x").select("idx", rounded(F.col("x")).alias("x"))


# --- whole runs ------------------------------------------------------------


@query("fr_full")
def _(spark, sf_dir):
    return force.fruchterman_reingold(_circle(spark, sf_dir), SIZE).select("idx", "x", "y")


@query("fa2_full")
def _(spark, sf_dir):
    return force.force_atlas2(_circle(spark, sf_dir), SIZE).select("idx", "x", "y")


@query("smacof_full")
def _(spark, sf_dir):
    return force.stress_majorization(_circle(spark, sf_dir), SIZE).select("idx", "x", "y")


@query("yifan_hu_full")
def _(spark, sf_dir):
    return force.yifan_hu(_circle(spark, sf_dir), SIZE).select("idx", "x", "y")


@query("fr_user_graphs")
def _(spark, sf_dir):
    """A drawing of every user's transitions between event types: as many graphs as users."""
    g = graphs.user_transitions(spark, sf_dir)
    return force.fruchterman_reingold(g.with_nodes(static_layouts.circular(g, SIZE)), SIZE).select("graph_id", "idx", "x", "y")


# --- boxes and right angles ------------------------------------------------

_GRID = TRADE3 + ", p AS (SELECT idx, (idx % 5) * 100.0 AS x, (idx // 5) * 80.0 AS y, 60.0 AS w, 40.0 AS h FROM nodes), s AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM e JOIN p a ON a.idx = src JOIN p b ON b.idx = dst)"
_PORTS = """ends AS (SELECT eid, 'src' AS "end", src AS idx, ex - ax AS dx, ey - ay AS dy, ex AS ox, ey AS oy FROM s UNION ALL SELECT eid, 'dst', dst, ax - ex, ay - ey, ax, ay FROM s),
sides AS (SELECT *, CASE WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'e' ELSE 'w' END ELSE CASE WHEN dy >= 0 THEN 's' ELSE 'n' END END AS side FROM ends),
ports AS (SELECT eid, "end", idx, side, row_number() OVER (PARTITION BY idx, side ORDER BY CASE WHEN side IN ('n', 's') THEN ox ELSE oy END, eid, "end") / (count(*) OVER (PARTITION BY idx, side) + 1) AS position FROM sides)"""
_SCATTER = """
p AS (SELECT idx, (idx * 37 % 300)::DOUBLE AS x, (idx * 53 % 200)::DOUBLE AS y, 60.0::DOUBLE AS w, 40.0::DOUBLE
AS h FROM nodes), c AS (SELECT a.idx AS l, b.idx AS r, (a.w + b.w) / 2 + 5.0 AS gap FROM p a JOIN p b ON (a.x <
b.x OR (a.x = b.x AND a.idx < b.idx)) AND a.y - a.h / 2 < b.y + b.h / 2 AND b.y - b.h / 2 < a.y + a.h / 2)"""


def _boxed(spark: SparkSession, sf_dir: str, x, y) -> Graph:
    g = graphs.trade3(spark, sf_dir)
    return g.with_nodes(g.nodes.withColumn("x", x.cast("double")).withColumn("y", y.cast("double")).withColumn("width", F.lit(60.0)).withColumn("height", F.lit(40.0)))


def _grid(spark: SparkSession, sf_dir: str) -> Graph:
    return _boxed(spark, sf_dir, F.col("idx") % 5 * 100, F.floor(F.col("idx") / 5) * 80)


def _scattered(spark: SparkSession, sf_dir: str) -> Graph:
    return _boxed(spark, sf_dir, F.col("idx") * 37 % 300, F.col("idx") * 53 % 200)


@query("port_sides", f"WITH {_GRID}, {_PORTS} SELECT eid, \"end\", idx, side, {_r('position')} AS position FROM ports")
def _(spark, sf_dir):
    return orthogonal.ports(_grid(spark, sf_dir)).select("eid", "end", "idx", "side", rounded(F.col("position")).alias("position"))


@query("port_points", f"WITH {_GRID}, {_PORTS} SELECT eid, \"end\", {_r("CASE side WHEN 'e' THEN x + w / 2 WHEN 'w' THEN x - w / 2 ELSE x + (position - 0.5) * w END")} AS x, {_r("CASE side WHEN 's' THEN y + h / 2 WHEN 'n' THEN y - h / 2 ELSE y + (position - 0.5) * h END")} AS y FROM ports JOIN p USING (idx)")
def _(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return orthogonal.port_points(g, orthogonal.ports(g)).select("eid", "end", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(
    "route_measures",
    f"""
    WITH {_GRID}, {_PORTS},
    pp AS (SELECT eid, "end", side, CASE side WHEN 'e' THEN x + w / 2 WHEN 'w' THEN x - w / 2 ELSE x + (position - 0.5) * w END AS x,
           CASE side WHEN 's' THEN y + h / 2 WHEN 'n' THEN y - h / 2 ELSE y + (position - 0.5) * h END AS y FROM ports JOIN p USING (idx)),
    r AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.side IN ('e', 'w') AS level
          FROM pp a JOIN pp b ON a.eid = b.eid AND a."end" = 'src' AND b."end" = 'dst')
    SELECT sum(CASE WHEN level AND y1 = y2 OR NOT level AND x1 = x2 THEN 0 ELSE 2 END)::BIGINT AS bends,
           {_r('sum(abs(x1 - x2) + abs(y1 - y2))', 3)} AS length FROM r
    """,
)
def _(spark, sf_dir):
    return orthogonal.route_measures(orthogonal.routes(_grid(spark, sf_dir))).select("bends", rounded(F.col("length"), 3).alias("length"))


@query("overlap_dag", f"WITH {TRADE3}, {_SCATTER} SELECT l AS \"left\", r AS \"right\", gap FROM c")
def _(spark, sf_dir):
    return orthogonal.neighbours_along(_scattered(spark, sf_dir).nodes, "x", 5.0).select("left", "right", "gap")


@query(
    "compaction_longest_path",
    f"""
    WITH RECURSIVE {TRADE3}, {_SCATTER}, walk AS (SELECT idx, (SELECT min(x) FROM p) AS x FROM p UNION
    SELECT r, x + gap FROM walk JOIN c ON l = idx) SELECT idx, max(x) AS x FROM walk GROUP BY idx
    """,
)
def _(spark, sf_dir):
    nodes = _scattered(spark, sf_dir).nodes
    return orthogonal.separated(nodes, orthogonal.neighbours_along(nodes, "x", 5.0), "x", compact=True).select("idx", "x")


@query(
    "packed_regions",
    f"""
    WITH p AS (SELECT n_nationkey::BIGINT AS idx, n_regionkey AS c, (n_nationkey * 37 % 101)::DOUBLE AS x, (n_nationkey * 53 % 97)::DOUBLE AS y FROM nation),
    b AS (SELECT c, min(x) - 4 AS x0, min(y) - 3 AS y0, max(x) - min(x) + 28 AS w, max(y) - min(y) + 26 AS h FROM p GROUP BY c),
    k AS (SELECT *, floor(coalesce(sum(w) OVER (ORDER BY h DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(max(w) OVER (), sqrt(sum(w * h) OVER ()))) AS shelf FROM b),
    a AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY shelf ORDER BY h DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS px FROM k),
    t AS (SELECT shelf, coalesce(sum(max(h)) OVER (ORDER BY shelf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS py FROM k GROUP BY shelf)
    SELECT idx, {_r('x + px - x0')} AS x, {_r('y + py - y0')} AS y FROM p JOIN a USING (c) JOIN t USING (shelf)
    """,
)
def _(spark, sf_dir):
    """The regions' boxes side by side in shelves."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = (F.lit("g").alias("graph_id"), F.col("n_nationkey").cast("long").alias("idx"))
    x, y = (F.col("n_nationkey") * 37 % 101).cast("double"), (F.col("n_nationkey") * 53 % 97).cast("double")
    nodes = nation.select(*key, x.alias("x"), y.alias("y"), F.lit(8.0).alias("width"), F.lit(6.0).alias("height"))
    return _xy(orthogonal.pack_components(nodes, nation.select(*key, F.col("n_regionkey").alias("component"))))


@query(
    "acyclic_edges",
    f"""
    WITH RECURSIVE {TRADE3}, {REACH}, t AS (SELECT e.*, src > dst AND EXISTS (SELECT 1 FROM reach WHERE a = dst AND
    b = src) AS r FROM e) SELECT eid, CASE WHEN r THEN dst ELSE src END AS src, CASE WHEN r THEN src ELSE dst END AS
    dst, r AS reversed FROM t
    """,
)
def _(spark, sf_dir):
    return multilevel.acyclic_edges(graphs.trade3(spark, sf_dir)).select("eid", "src", "dst", "reversed")


@query(
    "planar_bound",
    f"""
    WITH {TRADE3} SELECT (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM e)) <= 3 *
    n - 6 AS possible FROM n
    """,
)
def _(spark, sf_dir):
    return multilevel.is_planar_possible(graphs.trade3(spark, sf_dir)).select("possible")


@query("coarsened_edges")
def _(spark, sf_dir):
    return multilevel.coarsened(graphs.trade3(spark, sf_dir))[0].edges.select("eid", "src", "dst")


@query("spectral_trade3")
def _(spark, sf_dir):
    return multilevel.spectral(graphs.trade3(spark, sf_dir), SIZE).select("idx", "x", "y")


@query(
    "layered_tree_geo",
    """
    WITH reg AS (SELECT (1 + r_regionkey)::BIGINT AS reg FROM region), nat AS (SELECT (6 + n_nationkey)::BIGINT AS nat, (1 + n_regionkey)::BIGINT AS reg FROM nation),
    leaf AS (SELECT 6 + c_nationkey AS nat, (31 + c_custkey)::BIGINT AS idx FROM customer
      UNION ALL SELECT 6 + s_nationkey, (31 + (SELECT max(c_custkey) + 1 FROM customer) + s_suppkey)::BIGINT FROM supplier),
    ends AS (SELECT reg, nat, idx, 50.0 * (row_number() OVER (ORDER BY reg, nat, idx) - 1) AS x FROM reg LEFT JOIN nat USING (reg) LEFT JOIN leaf USING (nat)),
    nats AS (SELECT nat, any_value(reg) AS reg, (min(x) + max(x))::DOUBLE / 2 AS x FROM ends WHERE nat IS NOT NULL GROUP BY nat),
    regs AS (SELECT reg, (min(x) + max(x))::DOUBLE / 2 AS x FROM (SELECT reg, x FROM nats UNION ALL SELECT reg, x FROM ends WHERE nat IS NULL) GROUP BY reg)
    SELECT idx, x::DOUBLE AS x, 300::DOUBLE AS y FROM ends WHERE idx IS NOT NULL UNION ALL SELECT nat, x, 200 FROM nats
    UNION ALL SELECT reg, x, 100 FROM regs UNION ALL SELECT 0, (min(x) + max(x)) / 2, 0 FROM regs
    """,
)
def _(spark, sf_dir):
    return multilevel.layered_tree(graphs.geo(spark, sf_dir)).select("idx", "x", "y")


@query(
    "width_bounded_layers",
    f"""
    WITH RECURSIVE {DAG}, walk AS (SELECT idx, 0::BIGINT AS d FROM nodes WHERE idx NOT IN (SELECT dst FROM e) UNION
    SELECT dst, d + 1 FROM walk JOIN e ON src = idx), l AS (SELECT idx, max(d) AS layer FROM walk GROUP BY idx),
    c AS (SELECT layer, count(*) AS c, row_number() OVER (ORDER BY layer) AS k FROM l GROUP BY layer),
    m AS (SELECT k, layer, 0::BIGINT AS to_, c AS w FROM c WHERE k = 1 UNION ALL
      SELECT c.k, c.layer, CASE WHEN w + c > 6 THEN to_ + 1 ELSE to_ END, CASE WHEN w + c > 6 THEN c ELSE w + c END FROM m JOIN c ON c.k = m.k + 1)
    SELECT idx, to_ AS layer FROM l JOIN m USING (layer)
    """,
)
def _(spark, sf_dir):
    layers = traversal.longest_path_layers(graphs.dag(spark, sf_dir))
    return multilevel.width_bounded_layers(layers, 6).select("idx", "layer")


def _averaged(k: int) -> str:
    mean = f"SELECT src AS idx, avg(q.x) AS x, avg(q.y) AS y FROM bth JOIN t{k - 1} q ON q.idx = dst GROUP BY src"
    return f"t{k} AS (SELECT p.idx, coalesce(p.rx, m.x, p.x) AS x, coalesce(p.ry, m.y, p.y) AS y, p.rx, p.ry FROM t{k - 1} p LEFT JOIN ({mean}) m ON m.idx = p.idx)"


@query(
    "tutte_round3",
    f"""
    WITH {TRADE3}, bth AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
    t0 AS (SELECT idx, CASE WHEN idx < 8 THEN 500 + 460 * cos(2 * pi() * idx / 8) ELSE 500 END AS x, CASE WHEN idx < 8 THEN 500 + 460 * sin(2 * pi() * idx / 8) ELSE 500 END AS y,
      CASE WHEN idx < 8 THEN 500 + 460 * cos(2 * pi() * idx / 8) END AS rx, CASE WHEN idx < 8 THEN 500 + 460 * sin(2 * pi() * idx / 8) END AS ry FROM nodes),
    {_averaged(1)}, {_averaged(2)}, {_averaged(3)}
    SELECT idx, {_r("x")} AS x, {_r("y")} AS y FROM t3
    """,
)
def _(spark, sf_dir):
    """Three rounds of Tutte's placement, with the first eight nations round the others."""
    g = graphs.trade3(spark, sf_dir)
    rim = g.nodes.where("idx < 8").select("graph_id", "idx", F.col("idx").alias("pos"))
    return _xy(multilevel.barycentric(g, rim, SIZE, rounds=3), "idx")


@query("multilevel_trade3")
def _(spark, sf_dir):
    return multilevel.multilevel(graphs.trade3(spark, sf_dir), SIZE).select("idx", "x", "y")


# --- routes round boxes ----------------------------------------------------

_ROUTES = f"""{_GRID}, {_PORTS},
pp AS (SELECT eid, "end", side, CASE side WHEN 'e' THEN x + w / 2 WHEN 'w' THEN x - w / 2 ELSE x + (position - 0.5) * w END AS x,
       CASE side WHEN 's' THEN y + h / 2 WHEN 'n' THEN y - h / 2 ELSE y + (position - 0.5) * h END AS y FROM ports JOIN p USING (idx)),
r AS (SELECT a.eid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.side AS side1, b.side AS side2, a.side IN ('e', 'w') AS level FROM pp a JOIN pp b ON a.eid = b.eid AND a."end" = 'src' AND b."end" = 'dst'),
rt AS (SELECT eid, side1, side2, CASE WHEN level AND y1 = y2 OR NOT level AND x1 = x2 THEN [{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}]
  WHEN level THEN [{{'x': x1, 'y': y1}}, {{'x': (x1 + x2) / 2, 'y': y1}}, {{'x': (x1 + x2) / 2, 'y': y2}}, {{'x': x2, 'y': y2}}]
  ELSE [{{'x': x1, 'y': y1}}, {{'x': x1, 'y': (y1 + y2) / 2}}, {{'x': x2, 'y': (y1 + y2) / 2}}, {{'x': x2, 'y': y2}}] END AS points FROM r)"""


@query(
    "route_hits",
    f"""
    WITH {_ROUTES}, k AS (SELECT eid, points, unnest(range(len(points) - 1)) AS seg FROM rt),
    sg AS (SELECT eid, seg, points[seg + 1].x AS ux, points[seg + 1].y AS uy, points[seg + 2].x AS vx, points[seg + 2].y AS vy FROM k)
    SELECT sg.eid, sg.seg::INT AS seg, p.idx FROM sg JOIN e ON e.eid = sg.eid JOIN p ON p.idx NOT IN (e.src, e.dst)
    WHERE (ux <> vx OR uy <> vy) AND least(ux, vx) < x + w / 2 AND greatest(ux, vx) > x - w / 2 AND least(uy, vy) < y + h / 2 AND greatest(uy, vy) > y - h / 2
    """,
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return routing.route_hits(orthogonal.routes(g), g).select("eid", "seg", "idx")


def _costs_sql(turns: int) -> str:
    """The least costs of states (a point and the axis it was reached along) after 0, 1 ... turns, each one table."""
    run = lambda level: ("y", "h", "x") if level else ("x", "v", "y")

    def moves(s: str, turn: bool) -> str:
        parts = []
        for level in (True, False):
            same, lane, along = run(level)
            parts.append(f"""SELECT s.eid, t.x, t.y, {level} AS level, cost + abs(t.{along} - s.{along}) + {50.0 if turn else 0.0} AS cost FROM {s} s JOIN gr f ON f.eid = s.eid AND f.x = s.x AND f.y = s.y
              JOIN gr t ON t.eid = f.eid AND t.{same} = f.{same} AND t.{lane} = f.{lane} AND t.{along} <> f.{along} WHERE s.level = {level != turn}""")
        return " UNION ALL ".join(parts)

    out = [f"s0 AS MATERIALIZED (SELECT eid, ax AS x, ay AS y, alevel AS level, 0.0::DOUBLE AS cost FROM st), c0 AS MATERIALIZED (SELECT * FROM s0 UNION ALL {moves('s0', False)})"]
    out += [f"c{k + 1} AS MATERIALIZED (SELECT eid, x, y, level, min(cost) AS cost FROM (SELECT * FROM c{k} UNION ALL {moves(f'c{k}', True)}) GROUP BY ALL)" for k in range(turns)]
    return ", ".join(out)


@query(
    "grid_route_costs",
    f"""
    WITH {_ROUTES}, bx AS (SELECT x - w / 2 - 10 AS x0, x + w / 2 + 10 AS x1, y - h / 2 - 10 AS y0, y + h / 2 + 10 AS y1 FROM p),
    sb AS (SELECT eid, "end", side IN ('e', 'w') AS level, x + CASE side WHEN 'e' THEN 10 WHEN 'w' THEN -10 ELSE 0 END AS x, y + CASE side WHEN 's' THEN 10 WHEN 'n' THEN -10 ELSE 0 END AS y FROM pp),
    st AS (SELECT a.eid, a.x AS ax, a.y AS ay, a.level AS alevel, b.x AS tx, b.y AS ty, b.level AS blevel FROM sb a JOIN sb b ON a.eid = b.eid AND a."end" = 'src' AND b."end" = 'dst'),
    xs AS (SELECT DISTINCT eid, x FROM (SELECT eid, unnest([x0, x1]) AS x FROM st, bx UNION ALL SELECT eid, x FROM sb)), ys AS (SELECT DISTINCT eid, y FROM (SELECT eid, unnest([y0, y1]) AS y FROM st, bx UNION ALL SELECT eid, y FROM sb)),
    fr AS MATERIALIZED (SELECT eid, x, y, lag(x) OVER (PARTITION BY eid, y ORDER BY x) AS px, lag(y) OVER (PARTITION BY eid, x ORDER BY y) AS py FROM xs JOIN ys USING (eid)
      WHERE NOT EXISTS (SELECT 1 FROM bx WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)),
    br AS (SELECT *, EXISTS (SELECT 1 FROM bx WHERE y > y0 AND y < y1 AND x0 < x AND x1 > px)::INT AS bh, EXISTS (SELECT 1 FROM bx WHERE x > x0 AND x < x1 AND y0 < y AND y1 > py)::INT AS bv FROM fr),
    gr AS MATERIALIZED (SELECT eid, x, y, sum(bh) OVER (PARTITION BY eid, y ORDER BY x) AS h, sum(bv) OVER (PARTITION BY eid, x ORDER BY y) AS v FROM br),
    {_costs_sql(7)}
    SELECT eid, {_r('min(cost + CASE WHEN level = blevel THEN 0 ELSE 50 END) + 20', 3)} AS cost FROM c7 JOIN st USING (eid) WHERE x = tx AND y = ty GROUP BY eid
    """,
)
def _(spark, sf_dir):
    """The least of length and 50 a bend for every edge between 25 boxes."""
    return routing.grid_routes(_grid(spark, sf_dir).settled()).select("eid", rounded(F.col("cost"), 3).alias("cost"))


_F2 = lambda sql: f"printf('%.2f', {_r(sql, 2)})"


@query(
    "svg_orthogonal",
    f"""
    WITH {_ROUTES}, every AS (SELECT x - w / 2 AS x, y - h / 2 AS y FROM p UNION ALL SELECT x + w / 2, y + h / 2 FROM p UNION ALL SELECT q.x, q.y FROM (SELECT unnest(points[2:-2]) AS q FROM rt)),
    b AS (SELECT 40 - min(x) AS ox, 40 - min(y) AS oy, {_F2('max(x) - min(x) + 80')} AS bw, {_F2('max(y) - min(y) + 80')} AS bh FROM every)
    SELECT 0 AS part, 0::BIGINT AS at, printf('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s" viewBox="0 0 %s %s">', bw, bh, bw, bh) AS line FROM b UNION ALL
    SELECT 1, eid, '<polyline points="' || array_to_string(list_transform(points, lambda q: {_F2('q.x + ox')} || ',' || {_F2('q.y + oy')}), ' ') || '" fill="none" stroke="#5a6470" stroke-width="1.5"/>' FROM rt, b UNION ALL
    SELECT 2, idx, '<rect x="' || {_F2('x + ox - w / 2')} || '" y="' || {_F2('y + oy - h / 2')} || '" width="60.00" height="40.00" fill="#3f7fbf" stroke="#24527a" stroke-width="2.0"/>' FROM p, b UNION ALL
    SELECT 3, idx, '<text x="' || {_F2('x + ox')} || '" y="' || {_F2('y + oy')} || '" text-anchor="middle" dominant-baseline="central" font-family="sans-serif" font-size="12.0" fill="#000000">' || label || '</text>' FROM p JOIN nodes USING (idx), b
    UNION ALL SELECT 4, 0, '</svg>'
    """,
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return export.to_svg_orthogonal(g, orthogonal.routes(g)).drop("graph_id")


@query(
    "dot_orthogonal",
    f"""
    WITH {_ROUTES}
    SELECT 0 AS part, 0::BIGINT AS at, 'graph G {{' || chr(10) || '  graph [splines=ortho];' || chr(10) || '  node [shape=box, fixedsize=true];' AS line UNION ALL
    SELECT 1, idx, '  ' || idx || ' [label="' || label || '", pos="' || {_F2('x')} || ',' || {_F2('-y')} || '!", width="0.83", height="0.56"];' FROM p JOIN nodes USING (idx) UNION ALL
    SELECT 2, eid, '  ' || src || ' -- ' || dst || CASE WHEN len(points) > 2 THEN ' [comment="bends: ' || (len(points) - 2) || '"]' ELSE '' END || ';' FROM e JOIN rt USING (eid) UNION ALL SELECT 3, 0, '}}'
    """,
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return export.to_dot_orthogonal(g, orthogonal.routes(g)).drop("graph_id")


_KEYS = "".join(f'<key id="{k}" for="{o}" attr.name="{k}" attr.type="{t}"/>\n' for k, o, t in (
    ("x", "node", "double"), ("y", "node", "double"), ("width", "node", "double"), ("height", "node", "double"), ("label", "node", "string"),
    ("bends", "edge", "string"), ("source_side", "edge", "string"), ("target_side", "edge", "string"),
))
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + _KEYS + '<graph id="G" edgedefault="undirected">'


@query(
    "graphml_orthogonal",
    f"""
    WITH {_ROUTES}
    SELECT 0 AS part, 0::BIGINT AS at, '{_HEAD}' AS line UNION ALL
    SELECT 1, idx, printf('<node id="%d"><data key="x">%.6f</data><data key="y">%.6f</data><data key="width">60.000000</data><data key="height">40.000000</data><data key="label">%s</data></node>', idx, x, y, label)
    FROM p JOIN nodes USING (idx) UNION ALL
    SELECT 2, eid, printf('<edge id="e%d" source="%d" target="%d">', eid, src, dst) || CASE WHEN len(points) > 2 THEN '<data key="bends">' ||
      array_to_string(list_transform(points[2:-2], lambda q: {_F2('q.x')} || ',' || {_F2('q.y')}), ';') || '</data>' ELSE '' END ||
      '<data key="source_side">' || side1 || '</data><data key="target_side">' || side2 || '</data></edge>' FROM e JOIN rt USING (eid) UNION ALL
    SELECT 3, 0, '</graph>' || chr(10) || '</graphml>'
    """,
)
def _(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return export.to_graphml_orthogonal(g, orthogonal.routes(g), orthogonal.ports(g)).drop("graph_id")


# --- planar maps -----------------------------------------------------------

_SPOTS = "p AS (SELECT idx, (idx * 37 % 101)::DOUBLE AS x, (idx * 53 % 97)::DOUBLE AS y FROM nodes)"
TRADE1 = TRADE3.replace("r <= 3", "r <= 1")


def _spots(spark: SparkSession, sf_dir: str) -> Graph:
    g = graphs.trade3(spark, sf_dir)
    return g.with_nodes(g.nodes.withColumn("x", (F.col("idx") * 37 % 101).cast("double")).withColumn("y", (F.col("idx") * 53 % 97).cast("double")))


@query(
    "planarized_parts",
    f"""
    WITH {LINES}, {CROSS}, c AS (SELECT * FROM o WHERE t1 * t2 < 0 AND t3 * t4 < 0), m AS (SELECT e1 AS eid FROM c UNION ALL SELECT e2 FROM c)
    SELECT e.eid, count(m.eid) + 1 AS parts, (SELECT count(*) FROM c) + (SELECT n FROM n) AS nodes FROM e LEFT JOIN m ON m.eid = e.eid GROUP BY e.eid
    """,
)
def _(spark, sf_dir):
    found = planar.planarized(_circle(spark, sf_dir))
    total = found.nodes.agg(F.count("*").alias("nodes"))
    return found.edges.groupBy("eid").agg(F.count("*").alias("parts")).crossJoin(total)


@query(
    "faces_of_rotation",
    f"""
    WITH RECURSIVE {TRADE3}, {_SPOTS},
    d AS (SELECT eid * 2 AS dart, src AS node, atan2(b.y - a.y, b.x - a.x) AS angle FROM e JOIN p a ON a.idx = src JOIN p b ON b.idx = dst
          UNION ALL SELECT eid * 2 + 1, dst, atan2(a.y - b.y, a.x - b.x) FROM e JOIN p a ON a.idx = src JOIN p b ON b.idx = dst),
    t AS (SELECT xor(dart, 1) AS dart, coalesce(lead(dart) OVER (PARTITION BY node ORDER BY angle, dart), first_value(dart) OVER (PARTITION BY node ORDER BY angle, dart)) AS nxt FROM d),
    r AS (SELECT dart, dart AS here FROM t UNION SELECT r.dart, t.nxt FROM r JOIN t ON t.dart = r.here)
    SELECT dart // 2 AS eid, dart % 2 = 0 AS forward, min(here) AS face FROM r GROUP BY dart
    """,
)
def _(spark, sf_dir):
    return planar.faces(_spots(spark, sf_dir)).select("eid", "forward", "face")


_BLOCKS = f"""
    WITH RECURSIVE {TRADE1}, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT v.idx AS v, w.idx AS x, w.idx AS y FROM nodes v JOIN nodes w ON v.idx <> w.idx UNION SELECT r.v, r.x, s.b FROM r JOIN s ON s.a = r.y AND s.b <> r.v),
    ends AS (SELECT eid, src AS v, dst AS o FROM e UNION ALL SELECT eid, dst, src FROM e),
    near AS (SELECT DISTINCT p.eid AS a, q.eid AS b FROM ends p JOIN ends q ON p.v = q.v JOIN r ON r.v = p.v AND r.x = p.o AND r.y = q.o),
    c AS (SELECT eid, eid AS here FROM e UNION SELECT c.eid, near.b FROM c JOIN near ON near.a = c.here),
    blocks AS (SELECT eid, min(here) AS block FROM c GROUP BY eid)"""


@query("blocks", f"{_BLOCKS} SELECT * FROM blocks")
def _(spark, sf_dir):
    return planar.blocks(graphs.trade1(spark, sf_dir)).select("eid", "block")


@query("part_order_blocks")
def _(spark, sf_dir):
    """The graph of all orders and the parts in them: the block of each distinct pair."""
    return planar.blocks(graphs.part_orders(spark, sf_dir)).select("eid", "block")


@query("bridges", f"{_BLOCKS} SELECT min(eid) AS eid FROM blocks GROUP BY block HAVING count(*) = 1")
def _(spark, sf_dir):
    return planar.bridges(graphs.trade1(spark, sf_dir)).select("eid")


@query("cut_vertices", f"{_BLOCKS} SELECT v AS idx FROM blocks JOIN ends USING (eid) GROUP BY v HAVING count(DISTINCT block) > 1")
def _(spark, sf_dir):
    return planar.cut_vertices(graphs.trade1(spark, sf_dir)).select("idx")


@query(
    "cycle_edges",
    f"""
    WITH RECURSIVE {TRADE1}, {REACH}, ring AS (SELECT a AS idx FROM reach WHERE a = b), least AS (SELECT min(idx) AS idx FROM ring)
    SELECT src, dst FROM e, least WHERE src IN (SELECT idx FROM ring) AND (src = least.idx OR EXISTS (SELECT 1 FROM reach WHERE a = least.idx AND b = src))
    """,
)
def _(spark, sf_dir):
    return planar.find_cycle(graphs.trade1(spark, sf_dir)).select("src", "dst")


@query(
    "farthest_nodes",
    f"""
    WITH RECURSIVE {TRADE3}, {HOPS} SELECT source, min(idx) AS idx, any_value(d)::DOUBLE AS dist FROM (SELECT *,
    max(d) OVER (PARTITION BY source) AS most FROM hops) WHERE d = most GROUP BY source
    """,
)
def _(spark, sf_dir):
    g = graphs.trade3(spark, sf_dir)
    return planar.farthest(g, g.nodes.select("graph_id", F.col("idx").alias("source"))).select("source", "idx", "dist")


@query(
    "convex_hull",
    """
    WITH p AS (SELECT 'region ' || n_regionkey AS g, s_suppkey AS idx, round(s_acctbal) AS x, (s_suppkey * 53 % 997)::DOUBLE AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    u AS (SELECT g, min(idx) AS idx, x, y FROM p GROUP BY g, x, y),
    c AS (SELECT a.g, a.idx, a.x, a.y, b.x AS bx, b.y AS by FROM u a JOIN u b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)
          WHERE a.y <= (SELECT min(y) + 0 FROM u z WHERE z.g = a.g AND z.x = a.x) OR a.y >= (SELECT max(y) + 0 FROM u z WHERE z.g = a.g AND z.x = a.x)),
    bad AS (SELECT DISTINCT c.g, c.idx, c.bx, c.by FROM c JOIN u k ON k.g = c.g
            WHERE (c.bx - c.x) * (k.y - c.y) - (c.by - c.y) * (k.x - c.x) < 0
               OR (c.bx - c.x) * (k.y - c.y) - (c.by - c.y) * (k.x - c.x) = 0 AND (k.x - c.x) * (c.bx - c.x) + (k.y - c.y) * (c.by - c.y) > (c.bx - c.x) * (c.bx - c.x) + (c.by - c.y) * (c.by - c.y)
               OR (c.bx - c.x) * (k.y - c.y) - (c.by - c.y) * (k.x - c.x) = 0 AND (k.x - c.x) * (c.bx - c.x) + (k.y - c.y) * (c.by - c.y) < 0)
    SELECT DISTINCT c.g AS graph_id, c.idx FROM c LEFT JOIN bad ON bad.g = c.g AND bad.idx = c.idx AND bad.bx = c.bx AND bad.by = c.by WHERE bad.g IS NULL
    UNION ALL SELECT g, min(idx) FROM u GROUP BY g HAVING count(*) = 1
    """,
)
def _(spark, sf_dir):
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    own = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    y = (F.col("s_suppkey") * 53 % 997).cast("double").alias("y")
    spots = own.select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("graph_id"), F.col("s_suppkey").alias("idx"), F.round("s_acctbal").cast("double").alias("x"), y)
    return planar.convex_hull(spots).select("graph_id", "idx")


def _region_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' suppliers by balance and key, each region 12,000 to the right of the one before, as convex polygons."""
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    own = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    x = F.round("s_acctbal").cast("double") + 12000.0 * F.col("n_regionkey")
    spots = own.select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("s_suppkey").alias("idx"), x.alias("x"), (F.col("s_suppkey") * 53 % 997).cast("double").alias("y"))
    return planar.convex_hull(spots).withColumn("polygon", F.col("graph_id").cast("int")).withColumn("graph_id", F.lit("g"))


_TANGENTS = """
every AS (SELECT DISTINCT n_regionkey AS g, round(s_acctbal) + 12000.0::DOUBLE * n_regionkey AS x, (s_suppkey * 53 % 997)::DOUBLE AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT * FROM every WHERE g IN (SELECT g FROM every GROUP BY g HAVING count(*) > 2)),
c AS (SELECT a.g AS a, b.g AS b, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM u a JOIN u b ON a.g < b.g),
k AS (SELECT c.*, u.g = c.a AS own, sign((ex - ax) * (y - ay) - (ey - ay) * (x - ax)) AS s FROM c JOIN u ON u.g IN (c.a, c.b) AND NOT (x = ax AND y = ay) AND NOT (x = ex AND y = ey)),
t AS (SELECT a, b, ax, ay, ex, ey, max(s) FILTER (own) AS sa, max(s) FILTER (NOT own) AS sb FROM k GROUP BY ALL
  HAVING max(s) FILTER (own) = min(s) FILTER (own) AND max(s) FILTER (NOT own) = min(s) FILTER (NOT own) AND max(s) FILTER (own) <> 0 AND max(s) FILTER (NOT own) <> 0),
bt AS (SELECT a, b, ax, ay, ex AS bx, ey AS "by", CASE WHEN sa > 0 THEN 'l' ELSE 'r' END || CASE WHEN sb > 0 THEN 'l' ELSE 'r' END AS kind FROM t)"""


@query("hull_tangents", f"WITH {_TANGENTS} SELECT * FROM bt")
def _(spark, sf_dir):
    return polygons.tangents(_region_hulls(spark, sf_dir)).select("a", "b", "ax", "ay", "bx", "by", "kind")


@query(
    "visible_tangents",
    f"""
    WITH {_TANGENTS}, w AS (SELECT bt.*, u.g AS g, max(sign((bx - ax) * (u.y - ay) - (bt."by" - ay) * (u.x - ax))) AS hi, min(sign((bx - ax) * (u.y - ay) - (bt."by" - ay) * (u.x - ax))) AS lo
      FROM bt JOIN u ON u.g > bt.a AND u.g < bt.b GROUP BY ALL)
    SELECT * FROM bt WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = bt.a AND w.b = bt.b AND w.kind = bt.kind AND w.ax = bt.ax AND w.ay = bt.ay AND w.bx = bt.bx AND w."by" = bt."by" AND NOT (w.lo = w.hi AND w.hi <> 0))
    """,
)
def _(spark, sf_dir):
    """Tangents of regions that no region between them is in the way of."""
    hulls = _region_hulls(spark, sf_dir)
    return polygons.visible(polygons.tangents(hulls), hulls).select("a", "b", "ax", "ay", "bx", "by", "kind")


@query(
    "group_bounds",
    f"""
    WITH {TRADE3}, {_SPOTS}, one AS (SELECT n_regionkey::BIGINT AS gid, min(x) - 10 AS x0, min(y) - 10 AS y0, max(x) + 10 AS x1, max(y) + 10 AS y1 FROM p JOIN nation ON n_nationkey = idx GROUP BY 1)
    SELECT * FROM one UNION ALL SELECT 100, min(x0) - 10, min(y0) - 10, max(x1) + 10, max(y1) + 10 FROM one
    """,
)
def _(spark, sf_dir):
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    none = F.array().cast("array<bigint>")
    own = nation.groupBy(F.col("n_regionkey").cast("long").alias("gid")).agg(F.collect_list(F.col("n_nationkey").cast("long")).alias("leaves")).withColumn("children", none)
    top = region.agg(F.collect_list(F.col("r_regionkey").cast("long")).alias("children")).select(F.lit(100).cast("long").alias("gid"), none.alias("leaves"), "children")
    g = _spots(spark, sf_dir)
    groups = own.unionByName(top).crossJoin(F.broadcast(g.nodes.select("graph_id").distinct()))
    return planar.group_bounds(g.nodes, groups).drop("graph_id")


@query("groups_apart", "SELECT n_nationkey::BIGINT AS idx, n_regionkey::BIGINT AS gid, true AS inside, true AS apart FROM nation")
def _(spark, sf_dir):
    """The nations moved so that regions' boxes are apart: each nation within its region's box, and in no other's."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    own = nation.groupBy(F.col("n_regionkey").cast("long").alias("gid")).agg(F.collect_list(F.col("n_nationkey").cast("long")).alias("leaves")).withColumn("children", F.array().cast("array<bigint>"))
    nodes = nation.select(F.lit("g").alias("graph_id"), F.col("n_nationkey").cast("long").alias("idx"), (F.col("n_nationkey") * 37 % 101).cast("double").alias("x"), (F.col("n_nationkey") * 53 % 97).cast("double").alias("y"), F.lit(8.0).alias("width"), F.lit(6.0).alias("height"))
    groups = own.withColumn("graph_id", F.lit("g"))
    out = cut(grouping.with_groups_apart(nodes, groups, padding=2.0, gap=1.0))
    bounds = planar.group_bounds(out, groups, 2.0)
    home = groups.select("gid", F.explode("leaves").alias("idx"))
    within = (F.col("x") - 4 >= F.col("x0")) & (F.col("x") + 4 <= F.col("x1")) & (F.col("y") - 3 >= F.col("y0")) & (F.col("y") + 3 <= F.col("y1"))
    clear = (F.col("x") - 4 >= F.col("x1")) | (F.col("x") + 4 <= F.col("x0")) | (F.col("y") - 3 >= F.col("y1")) | (F.col("y") + 3 <= F.col("y0"))
    both = out.join(bounds.withColumnRenamed("gid", "other"), "graph_id").join(home, "idx")
    return both.groupBy("idx", "gid").agg(F.bool_and(F.when(F.col("gid") == F.col("other"), within).otherwise(True)).alias("inside"), F.bool_and(F.when(F.col("gid") != F.col("other"), clear).otherwise(True)).alias("apart"))


@query(
    "lanes",
    """
    WITH s AS (SELECT c_nationkey AS line, o_orderkey AS eid, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS lo, o_orderkey % 3 + 1 AS more FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT *, coalesce((lo >= max(lo + more) OVER (PARTITION BY line ORDER BY lo, lo + more, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM s),
    r AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY lo, lo + more, eid) AS run FROM b)
    SELECT eid, (row_number() OVER (PARTITION BY line, run ORDER BY eid) - 1 - (count(*) OVER (PARTITION BY line, run) - 1) / 2) * 10.0::DOUBLE AS "offset" FROM r
    """,
)
def _(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    lo = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("g").alias("graph_id"), F.col("o_orderkey").alias("eid"), F.lit(0).alias("seg"), F.lit(True).alias("level"), F.col("c_nationkey").cast("double").alias("line"), lo.alias("lo"), (lo + F.col("o_orderkey") % 3 + 1).alias("hi"))
    return planar.lanes(own).select("eid", "offset")


# --- export ----------------------------------------------------------------


@query(
    "svg_nodes",
    f"""
    WITH {PLACED}, b AS (SELECT 40 - (min(x) - 20) AS ox, 40 - (min(y) - 20) AS oy FROM p)
    SELECT idx AS at,
    printf('<circle cx="%.2f" cy="%.2f" r="20.00" fill="#3f7fbf" stroke="#24527a" stroke-width="2.0"/>',
    {_r('x + ox', 2)}, {_r('y + oy', 2)}) AS line FROM p, b
    """,
)
def _(spark, sf_dir):
    return export.to_svg(_circle(spark, sf_dir)).where("part = 2").select("at", "line")


@query("dot_edges", f"WITH {TRADE3} SELECT eid AS at, printf('  %d -- %d [weight=%.2f];', src, dst, weight) AS line FROM e")
def _(spark, sf_dir):
    return export.to_dot(_circle(spark, sf_dir)).where("part = 2").select("at", "line")


@query(
    "graphml_nodes",
    f"""
    WITH {PLACED} SELECT idx AS at,
    printf('<node id="n%d"><data key="x">%.6f</data><data key="y">%.6f</data><data key="label">%s</data></node>',
    idx, {_r('x')}, {_r('y')}, label) AS line FROM p
    """,
)
def _(spark, sf_dir):
    return export.to_graphml(_circle(spark, sf_dir)).where("part = 1").select("at", "line")


@query(
    "svg_document",
    f"""
    WITH {LINES}, b AS (SELECT 60 - min(x) AS ox, 60 - min(y) AS oy, {_F2('max(x) - min(x) + 120')} AS bw, {_F2('max(y) - min(y) + 120')} AS bh FROM p)
    SELECT 0 AS part, 0::BIGINT AS at, printf('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s" viewBox="0 0 %s %s">', bw, bh, bw, bh) AS line FROM b UNION ALL
    SELECT 1, eid, '<line x1="' || {_F2('ax + ox')} || '" y1="' || {_F2('ay + oy')} || '" x2="' || {_F2('ex + ox')} || '" y2="' || {_F2('ey + oy')} || '" stroke="#5a6470" stroke-width="1.5"/>' FROM s, b UNION ALL
    SELECT 2, idx, '<circle cx="' || {_F2('x + ox')} || '" cy="' || {_F2('y + oy')} || '" r="20.00" fill="#3f7fbf" stroke="#24527a" stroke-width="2.0"/>' FROM p, b UNION ALL
    SELECT 3, idx, '<text x="' || {_F2('x + ox')} || '" y="' || {_F2('y + oy')} || '" text-anchor="middle" dominant-baseline="central" font-family="sans-serif" font-size="12.0" fill="#000000">' || label || '</text>' FROM p, b
    UNION ALL SELECT 4, 0, '</svg>'
    """,
)
def _(spark, sf_dir):
    return export.to_svg(_circle(spark, sf_dir)).drop("graph_id")


@query(
    "dot_document",
    f"""
    WITH {PLACED} SELECT 0 AS part, 0::BIGINT AS at, 'graph G {{' || chr(10) || '  node [shape=ellipse];' AS line UNION ALL
    SELECT 1, idx, '  ' || idx || ' [label="' || label || '", pos="' || printf('%.4f', {_r('x / 72', 4)}) || ',' || printf('%.4f', {_r('-y / 72', 4)}) || '!"];' FROM p UNION ALL
    SELECT 2, eid, printf('  %d -- %d [weight=%.2f];', src, dst, weight) FROM e UNION ALL SELECT 3, 0, '}}'
    """,
)
def _(spark, sf_dir):
    return export.to_dot(_circle(spark, sf_dir)).drop("graph_id")


_PLAIN_KEYS = "".join(f'<key id="{k}" for="{o}" attr.name="{k}" attr.type="{t}"/>\n' for k, o, t in (
    ("x", "node", "double"), ("y", "node", "double"), ("width", "node", "double"), ("height", "node", "double"), ("label", "node", "string"), ("weight", "edge", "double"), ("length", "edge", "double"),
))
_PLAIN_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + _PLAIN_KEYS + '<graph id="G" edgedefault="undirected">'


@query(
    "graphml_document",
    f"""
    WITH {PLACED} SELECT 0 AS part, 0::BIGINT AS at, '{_PLAIN_HEAD}' AS line UNION ALL
    SELECT 1, idx, printf('<node id="n%d"><data key="x">%.6f</data><data key="y">%.6f</data><data key="label">%s</data></node>', idx, {_r('x')}, {_r('y')}, label) FROM p UNION ALL
    SELECT 2, eid, printf('<edge id="e%d" source="n%d" target="n%d"><data key="weight">%.6f</data></edge>', eid, src, dst, weight) FROM e UNION ALL
    SELECT 3, 0, '</graph>' || chr(10) || '</graphml>'
    """,
)
def _(spark, sf_dir):
    return export.to_graphml(_circle(spark, sf_dir)).drop("graph_id")
