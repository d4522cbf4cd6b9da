import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import export, force, ingest, layered, metrics, similarity, static_layouts, traversal
from vertexloom.operators.components import component_labels
from vertexloom.sources import graphs


def graph(spark, edges, n=None, xy=None):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)] or [], "eid long, src long, dst long")
    n = n if n is not None else max((max(e) for e in edges), default=-1) + 1
    nodes = spark.createDataFrame([(i, *(float(v) for v in (xy[i] if xy else (0, 0)))) for i in range(n)], "idx long, x double, y double")
    return graphs.graph(nodes, rows.withColumn("graph_id", F.lit("g")))


def scalar(df):
    return df.drop("graph_id").first()[0]


@pytest.mark.parametrize(
    "xy,edges,touching,strict",
    [
        ([(0, 0), (100, 0), (50, 87)], [(0, 1), (1, 2), (2, 0)], 0, 0),
        ([(0, 0), (100, 0), (100, 100), (0, 100)], [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)], 1, 1),
        ([(0, 0), (100, 0), (50, 0), (150, 0)], [(0, 1), (2, 3)], 1, 0),
        ([(0, 0), (100, 0), (50, 0), (50, 50)], [(0, 1), (2, 3)], 1, 0),
        ([(0, 0), (50, 0), (60, 0), (100, 0)], [(0, 1), (2, 3)], 0, 0),
        ([(0, 0), (0, 0)], [(0, 1)], 0, 0),
    ],
)
def test_crossings(spark, xy, edges, touching, strict):
    g = graph(spark, edges, xy=xy)
    assert scalar(metrics.edge_crossings(g)) == touching
    assert metrics.crossing_points(g).count() == strict


def test_crossings_do_not_depend_on_the_grid(spark):
    rng = random.Random(1)
    xy = [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(30)]
    g = graph(spark, [tuple(rng.sample(range(30), 2)) for _ in range(60)], xy=xy)
    assert len({scalar(metrics.edge_crossings(g, cells)) for cells in (1, 5, 64)}) == 1


def test_stress_and_lengths(spark):
    g = graph(spark, [(0, 1), (1, 2)], xy=[(0, 0), (100, 0), (200, 0)])
    assert scalar(metrics.stress(g)) < 1e-12
    assert scalar(metrics.stress(graph(spark, [(0, 1), (1, 2)], xy=[(0, 0), (50, 0), (100, 0)]))) == pytest.approx(0.25)
    assert metrics.length_summary(g).first()[1:] == (0.0, 1.0)
    assert metrics.length_summary(graph(spark, [], 2)).first()[1:] == (0.0, 1.0)
    assert scalar(metrics.angular_resolution(g)) == pytest.approx(180)
    assert scalar(metrics.angular_resolution(graph(spark, [], 2))) == 360


def test_structure_against_plain_python(spark):
    rng = random.Random(7)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    g = graph(spark, edges, n)
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def hops(start, out):
        dist, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        return dist

    reach = {v: hops(v, near) for v in range(n)}
    assert {r.idx: r.component for r in traversal.components(g).collect()} == {v: min(reach[v]) for v in range(n)}
    assert {(r.source, r.idx): r.dist for r in traversal.all_pairs(g).collect()} == {(v, w): float(d) for v in range(n) for w, d in reach[v].items()}
    out = {v: {b for a, b in edges if a == v} for v in range(n)}
    fwd = {v: set(hops(v, out)) for v in range(n)}
    assert {r.idx: r.component for r in traversal.strong_components(g).collect()} == {v: min(w for w in fwd[v] if v in fwd[w]) for v in range(n)}
    assert scalar(traversal.has_cycle(g)) == any(v in fwd[w] for v in range(n) for w in out[v])
    path = traversal.shortest_path(g, "g", 0, max(reach[0]))
    assert path[0] == 0 and path[-1] == max(reach[0]) and len(path) == reach[0][path[-1]] + 1


def test_two_colouring(spark):
    even = graph(spark, [(i, (i + 1) % 6) for i in range(6)], 7)
    assert [tuple(r)[1:] for r in traversal.two_colouring(even).orderBy("idx").collect()] == [(i, i % 2 if i < 6 else 0, True) for i in range(7)]
    assert not traversal.two_colouring(graph(spark, [(i, (i + 1) % 5) for i in range(5)])).first().bipartite
    assert not traversal.two_colouring(graph(spark, [(0, 0)])).first().bipartite


def test_layers_and_orders(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 2)], 5)
    assert {r.idx: r.layer for r in traversal.longest_path_layers(g).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0}
    assert [r.idx for r in traversal.topological_order(g).orderBy("pos").collect()] == [0, 3, 4, 1, 2]
    ring = graph(spark, [(0, 1), (1, 0)])
    assert traversal.topological_order(ring).count() == 0 and scalar(traversal.has_cycle(ring))
    assert {r.layer for r in traversal.longest_path_layers(ring).collect()} <= {0, 1}
    out = layered.layered(g, iterations=2)
    assert out.count() == 5 and {r.y for r in out.collect()} == {0.0, 100.0, 200.0}


def test_bilayer_crossings(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(80)]
    want = sum(a < c and b > d for a, b in pairs for c, d in pairs)
    assert scalar(layered.bilayer_crossings(spark.createDataFrame(pairs, "top long, bottom long"))) == want
    assert scalar(layered.bilayer_crossings(spark.createDataFrame([], "top long, bottom long"))) == 0


def test_bilayer_crossings_between_blocks(spark):
    """Repeated edges, a node with edges in many blocks, and graphs side by side, in blocks of a few edges."""
    rng = random.Random(3)
    pairs = [(rng.choice("ab"), rng.choice((3, 3, 3, rng.randrange(20))), rng.randrange(-9, 9)) for _ in range(400)] + [("c", 1, 1), (None, 1, 2), (None, 2, 1), ("a", None, 1)]
    want = {k: sum(x == y == k and t < u and b > c for x, t, b in pairs for y, u, c in pairs if None not in (t, u)) for k in ("a", "b", "c", None)}
    frame = spark.createDataFrame(pairs, "graph_id string, top long, bottom long")
    for block in (7, 10_000):
        assert {r.graph_id: r.crossings for r in layered.bilayer_crossings(frame, ("graph_id",), block).collect()} == want
        assert scalar(layered.bilayer_crossings(frame.where("graph_id = 'a'").drop("graph_id"), block=block)) == want["a"]



def test_validation(spark):
    g = graph(spark, [(0, 1), (1, 5)], 3)
    with pytest.raises(ingest.InvalidLinkError):
        ingest.validate(g)
    groups = spark.createDataFrame([("g", 0, [0, 9], [])], "graph_id string, gid long, leaves array<long>, children array<long>")
    with pytest.raises(ingest.InvalidGroupError):
        ingest.validate(graph(spark, [(0, 1)]), groups)
    for bad in ((0, 1), (1,), (-1, 5)):
        with pytest.raises(ingest.InvalidCanvasSizeError):
            ingest.check_canvas(bad)
    for f, bad in ((ingest.check_iterations, 0), (ingest.check_alpha, 1.5)):
        with pytest.raises(ingest.ValidationError):
            f(bad)


def test_fixed_nodes_stay(spark):
    g = graph(spark, [(0, 1), (1, 2)], xy=[(1, 2), (5, 6), (9, 9)])
    held = g.with_nodes(g.nodes.withColumn("fixed", F.when(F.col("idx") == 1, 1).otherwise(0)))
    for out in (static_layouts.circular(held), static_layouts.random_layout(held), static_layouts.shell(held, auto=2), force.fruchterman_reingold_tick(held, held.nodes), force.spring_tick(held, held.nodes), force.force_atlas2_tick(held, held.nodes)):
        assert out.where("idx = 1").select("x", "y").first() == (5.0, 6.0)


def test_many_graphs_at_once(spark):
    one = graph(spark, [(0, 1), (1, 2), (2, 0)])
    both = graphs.Graph(*(a.unionByName(a.withColumn("graph_id", F.lit("h"))) for a in (one.nodes, one.edges)))
    placed = static_layouts.circular(both)
    assert placed.groupBy("graph_id").count().where("count = 3").count() == 2
    assert {r.graph_id: r.crossings for r in metrics.edge_crossings(both.with_nodes(placed)).collect()} == {"g": 0, "h": 0}


def test_energy_falls(spark):
    g = graph(spark, [(i, (i + 1) % 8) for i in range(8)])
    start = static_layouts.random_layout(g, (500.0, 500.0), seed=3)
    ideal = force._ideal(g, 100.0, None)
    after = force.stress_majorization(g.with_nodes(start), (500.0, 500.0), iterations=15)
    assert scalar(force.raw_stress(after, ideal)) < 0.5 * scalar(force.raw_stress(start, ideal))
    seen = []
    force.run(lambda nodes, _: force.spring_tick(g, nodes), start, iterations=4, every=2, listen=seen.append)
    assert [p.kind for p in seen] == ["start", "tick", "tick", "end"]


def test_exports_parse_back(spark, tmp_path):
    import xml.etree.ElementTree as ET

    g = graph(spark, [(0, 1), (1, 2)], xy=[(0, 0), (10, 20), (30, 5)])
    g = g.with_nodes(g.nodes.withColumn("label", F.lit('a<b>"&')))
    svg = ET.fromstring(export.documents(export.to_svg(g)).first().text)
    assert len(svg.findall("{*}line")) == 2 and len(svg.findall("{*}circle")) == 3 and svg.find("{*}text").text == 'a<b>"&'
    assert len(ET.fromstring(export.documents(export.to_svg(g, shape="rect")).first().text).findall("{*}rect")) == 3
    text = export.documents(export.to_graphml(g)).first().text
    path = tmp_path / "g.graphml"
    path.write_text(text)
    back = graphs.read_graphml(spark, str(path))
    assert back.nodes.count() == 3 and sorted(map(tuple, back.edges.select("src", "dst").collect())) == [(0, 1), (1, 2)]
    dot = export.documents(export.to_dot(g, directed=True)).first().text
    assert dot.startswith("digraph G {") and "0 -> 1" in dot and dot.endswith("}")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\n# d\n0,2\n2,1\n")
    assert graphs.read_edge_csv(spark, str(tmp_path / "a.csv")).nodes.count() == 3
    (tmp_path / "a.json").write_text('{"nodes": [{"id": 0}, {"id": 1}], "links": [{"source": 0, "target": 1}], "metadata": {}}')
    g = graphs.read_json(spark, str(tmp_path / "a.json"))
    assert (g.nodes.count(), g.edges.count()) == (2, 1)
    (tmp_path / "a.gml").write_text('graph [\n  node [ id 5 label "x" ]\n  node [ id 9 ]\n  edge [ source 9 target 5 ]\n]')
    g = graphs.read_gml(spark, str(tmp_path / "a.gml"))
    assert g.edges.select("src", "dst").first() == (1, 0)


def test_similarity(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    got = {r.eid: r.length for r in similarity.jaccard_lengths(g).collect()}
    assert got[0] == pytest.approx(1 + 1 / 3) and got[3] == 1.0
    assert {r.eid: r.length for r in similarity.symmetric_difference_lengths(g).collect()}[0] == pytest.approx(1 + math.sqrt(2))
    assert similarity.separation_constraints(g).select("left", "right").collect() == [(2, 3)]


def test_long_chain_of_components(spark):
    n = 2000
    edges = spark.range(n - 1).select(((F.col("id") * 7919) % n).alias("src"), (((F.col("id") + 1) * 7919) % n).alias("dst"))
    out = component_labels(edges).groupBy("component").count().collect()
    assert [tuple(r) for r in out] == [(0, n)]
    assert component_labels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rounds_of_components_are_tables(spark):
    links = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = component_labels(links)
        state = [x for x in found.inputFiles() if "/rounds-" in x]
        assert state and found.agg({"component": "max"}).first()[0] == 0 and found.count() == 301
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
