import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graphs import graph, scalar

from vertexloom.operators import force, metrics, multilevel, orthogonal, planar, small_graphs, static_layouts, traversal
from vertexloom.sources import graphs


def boxes(spark, g, w=20.0, h=10.0):
    return g.with_nodes(g.nodes.withColumn("width", F.lit(w)).withColumn("height", F.lit(h)))


def test_ports_and_routes(spark):
    g = boxes(spark, graph(spark, [(0, 1), (0, 2), (0, 3)], xy=[(0, 0), (100, 0), (100, 30), (0, 80)]))
    got = {(r.eid, r.end): (r.side, round(r.position, 3)) for r in orthogonal.ports(g).collect()}
    assert got[0, "src"] == ("e", 0.333) and got[1, "src"] == ("e", 0.667) and got[2, "src"] == ("s", 0.5) and got[2, "dst"] == ("n", 0.5)
    routed = orthogonal.routes(g)
    for r in routed.collect():
        assert all(a.x == pytest.approx(b.x) or a.y == pytest.approx(b.y) for a, b in zip(r.points, r.points[1:], strict=False))
    assert orthogonal.route_measures(routed).first().bends >= 1


def test_overlaps_go(spark):
    g = boxes(spark, graph(spark, [], 5, [(0, 0), (5, 3), (10, -3), (200, 0), (8, 40)]))
    out = {r.idx: r for r in orthogonal.remove_overlaps(g.nodes, 1.0).collect()}
    for a in out.values():
        for b in out.values():
            assert a.idx == b.idx or abs(a.x - b.x) >= 20.999 or abs(a.y - b.y) >= 10.999
    assert (out[3].x, out[4].x) == (200.0, 8.0)


def test_packing_of_components(spark):
    g = boxes(spark, graph(spark, [(0, 1), (2, 3)], 5, [(0, 0), (50, 50), (10, 10), (60, 60), (0, 0)]))
    packed = orthogonal.pack_components(g.nodes, traversal.components(g), padding=5.0)
    rows = {r.idx: r for r in packed.collect()}
    assert rows[1].x - rows[0].x == 50 and rows[3].y - rows[2].y == 50
    box = lambda *ids: (min(rows[i].x for i in ids) - 10, max(rows[i].x for i in ids) + 10, min(rows[i].y for i in ids) - 5, max(rows[i].y for i in ids) + 5)
    parts = [box(0, 1), box(2, 3), box(4)]
    for i, p in enumerate(parts):
        for q in parts[:i]:
            assert p[1] <= q[0] or q[1] <= p[0] or p[3] <= q[2] or q[3] <= p[2]


def test_matching_is_maximal(spark):
    edges = [(i, (i + 1) % 12) for i in range(12)] + [(0, 6), (3, 3)]
    pairs = [(r.a, r.b) for r in multilevel.matching(graph(spark, edges)).collect()]
    used = [v for p in pairs for v in p]
    assert len(used) == len(set(used)) and all(p in edges or p[::-1] in edges for p in pairs)
    assert all(a in used or b in used for a, b in edges if a != b)
    small, mapped = multilevel.coarsened(graph(spark, edges))
    assert small.nodes.count() == 12 - len(pairs) and mapped.count() == 12


def test_spectral_separates_two_cliques(spark):
    edges = [(a, b) for c in (0, 5) for a in range(c, c + 5) for b in range(c, a)] + [(4, 5)]
    out = {r.idx: r.x for r in multilevel.spectral(graph(spark, edges), rounds=16).collect()}
    assert (max(out[i] for i in range(4)) < min(out[i] for i in range(6, 10))) or (min(out[i] for i in range(4)) > max(out[i] for i in range(6, 10)))


def test_barycentric_wheel_has_no_crossings(spark):
    g = graph(spark, [(i, (i + 1) % 5) for i in range(5)] + [(i, 5) for i in range(5)])
    rim = spark.createDataFrame([("g", i, i) for i in range(5)], "graph_id string, idx long, pos int")
    out = g.with_nodes(multilevel.barycentric(g, rim, rounds=20))
    assert scalar(metrics.edge_crossings(out)) == 0
    hub = out.nodes.where("idx = 5").first()
    assert (hub.x, hub.y) == (pytest.approx(500, abs=1), pytest.approx(500, abs=1))


def test_tree_and_acyclic_edges(spark):
    tree = graph(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)])
    out = {r.idx: (r.x, r.y) for r in multilevel.layered_tree(tree).collect()}
    assert out[3] == (0.0, 200.0) and out[4] == (50.0, 200.0) and out[1] == (25.0, 100.0) and out[0] == (62.5, 0.0)
    ring = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)])
    edges = multilevel.acyclic_edges(ring)
    assert not scalar(traversal.has_cycle(graphs.Graph(ring.nodes, edges.select("graph_id", "eid", "src", "dst"))))
    assert [r.eid for r in edges.where("reversed").collect()] == [2]


def test_merged_layers_and_bounds(spark):
    rows = [("g", i, [0, 1, 1, 2, 2, 2, 3][i]) for i in range(7)]
    out = multilevel.width_bounded_layers(spark.createDataFrame(rows, "graph_id string, idx long, layer long"), 3)
    assert {r.idx: r.layer for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}
    full = graph(spark, [(a, b) for a in range(5) for b in range(a)])
    assert not multilevel.is_planar_possible(full).first().possible
    assert multilevel.is_planar_possible(graph(spark, [(0, 1)])).first().possible


def test_multilevel_runs(spark):
    g = graph(spark, [(i, (i + 1) % 14) for i in range(14)])
    out = multilevel.multilevel(g, (200.0, 200.0), iterations=5, smallest=8)
    assert out.count() == 14 and out.where("isnan(x) or isnan(y) or x is null").count() == 0


def many(spark):
    """A ring, a star with a fixed node and a loop, a pair of parts, and a single node."""
    edges = [("a", i, (i + 1) % 7) for i in range(7)] + [("b", 0, i) for i in range(1, 6)] + [("b", 3, 3), ("c", 0, 1), ("c", 2, 3)]
    nodes = [(g, i, int(g == "b" and i == 2)) for g, n in (("a", 7), ("b", 6), ("c", 4), ("d", 1)) for i in range(n)]
    g = graphs.graph(spark.createDataFrame(nodes, "graph_id string, idx long, fixed int"), spark.createDataFrame(edges, "graph_id string, src long, dst long"))
    return g.with_nodes(static_layouts.random_layout(g, (300.0, 200.0), seed=3)).settled()


@pytest.mark.parametrize("layout", [force.fruchterman_reingold, force.spring, force.force_atlas2, force.yifan_hu, force.stress_majorization])
def test_runs_in_tasks_equal_ticks_as_queries(spark, layout):
    g = many(spark)
    cells = {} if layout is force.stress_majorization else {"leaf": 0}
    inside, outside = ({(r.graph_id, r.idx): (r.x, r.y) for r in layout(g, (300.0, 200.0), iterations=7, centre=False, in_task=n, **cells).collect()} for n in (1000, 4))
    assert inside.keys() == outside.keys() and len(inside) == 18
    for k, (x, y) in inside.items():
        assert outside[k] == (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6)), k
    still = g.nodes.where("fixed = 1").first()
    assert inside["b", 2] == (still.x, still.y)


def test_runs_lower_stress_and_energy(spark):
    ring = graph(spark, [(i, (i + 1) % 20) for i in range(20)])
    g = ring.with_nodes(static_layouts.random_layout(ring, seed=5)).settled()
    start = scalar(metrics.quality_summary(g).select("stress"))
    for layout in (force.stress_majorization, force.yifan_hu, force.fruchterman_reingold):
        assert scalar(metrics.quality_summary(g.with_nodes(layout(g))).select("stress")) < start / 2


def test_blocks_and_cut_vertices(spark):
    # two triangles at node 2, a bridge to 5, a double edge 5-6, and a part of its own
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 5), (7, 8), (8, 8)])
    of = {r.eid: r.block for r in planar.blocks(g).collect()}
    names = {(r.src, r.dst): r.eid for r in g.edges.collect()}
    groups = sorted(sorted(e for e, b in of.items() if b == k) for k in set(of.values()))
    want = [[(0, 1), (1, 2), (2, 0)], [(2, 3), (3, 4), (4, 2)], [(4, 5)], [(5, 6), (6, 5)], [(7, 8)]]
    assert groups == sorted(sorted(names[e] for e in group) for group in want)
    assert sorted(r.idx for r in planar.cut_vertices(g).collect()) == [2, 4, 5]


def test_planar_map_meets_eulers_formula(spark):
    g = graph(spark, [(0, 2), (1, 3), (0, 1), (1, 2), (2, 3), (3, 0)], xy=[(0, 0), (10, 0), (10, 10), (0, 10)])
    flat = planar.planarized(g)
    assert flat.nodes.count() == 5 and flat.edges.count() == 8
    again = graphs.Graph(flat.nodes, graphs.numbered(flat.edges.drop("eid"), "eid", "src", "dst"))
    assert planar.faces(again).select("face").distinct().count() == 8 - 5 + 2


def test_cycle_and_hull_and_groups(spark):
    g = graph(spark, [(5, 0), (0, 1), (1, 2), (2, 0), (2, 3), (4, 6), (6, 4), (6, 7)])
    assert sorted((r.src, r.dst) for r in planar.find_cycle(g).collect()) == [(0, 1), (1, 2), (2, 0)]
    assert planar.find_cycle(graph(spark, [(0, 1), (1, 2)])).count() == 0
    spots = spark.createDataFrame([("g", 0, 0.0, 0.0), ("g", 1, 2.0, 0.0), ("g", 2, 4.0, 0.0), ("g", 3, 4.0, 4.0), ("g", 4, 1.0, 1.0), ("g", 5, 4.0, 4.0), ("h", 0, 1.0, 1.0), ("i", 0, None, 1.0)], "graph_id string, idx long, x double, y double")
    assert [(r.graph_id, r.pos, r.idx) for r in planar.convex_hull(spots).orderBy("graph_id", "pos").collect()] == [("g", 0, 0), ("g", 1, 2), ("g", 2, 3), ("h", 0, 0)]
    groups = spark.createDataFrame([("g", 0, [4], []), ("g", 1, [], [0]), ("g", 2, [], [])], "graph_id string, gid long, leaves array<long>, children array<long>")
    sized = spots.withColumn("width", F.lit(2.0)).withColumn("height", F.lit(4.0))
    assert sorted(map(tuple, planar.group_bounds(sized, groups, 1.0).collect())) == [("g", 0, -1.0, -2.0, 3.0, 4.0), ("g", 1, -2.0, -3.0, 4.0, 5.0)]
    looped = spark.createDataFrame([("g", 0, [4], [0])], "graph_id string, gid long, leaves array<long>, children array<long>")
    with pytest.raises(ValueError, match="nested"):
        planar.group_bounds(sized, looped, 1.0, max_depth=3)


def test_lanes_of_overlapping_routes(spark):
    rows = [("g", e, 0, True, 0.0, a, b) for e, a, b in ((1, 0.0, 5.0), (2, 4.0, 6.0), (3, 5.5, 9.0), (4, 9.0, 12.0))]
    out = planar.lanes(spark.createDataFrame(rows, "graph_id string, eid long, seg int, level boolean, line double, lo double, hi double"), 2.0)
    assert {r.eid: r.offset for r in out.collect()} == {1: -2.0, 2: 0.0, 3: 2.0, 4: 0.0}
    routed = orthogonal.routes(boxes(spark, graph(spark, [(0, 1), (0, 2)], xy=[(0, 0), (100, 40), (100, 80)])))
    assert planar.lanes(planar.route_segments(routed)).count() > 0


SIDE = (200.0, 200.0)
TICKS = {
    "fr": lambda: small_graphs.fruchterman_reingold_tick(SIDE, lambda t: 20 * 0.95**t),
    "spring": lambda: small_graphs.spring_tick(SIDE),
    "fa2": lambda: small_graphs.force_atlas2_tick(SIDE),
    "yifan_hu": lambda: small_graphs.yifan_hu_tick(SIDE),
    "stress": lambda: small_graphs.stress_tick(),
}


@pytest.mark.parametrize("name", TICKS)
@pytest.mark.parametrize("n", [1, 2, 9])
def test_graphs_of_one_size_run_side_by_side_as_each_alone(name, n):
    rng = np.random.default_rng(n)
    alone = []
    for i in range(7):
        m = 0 if i == 3 else int(rng.integers(1, 3 * n))
        alone.append((rng.uniform(0, 200, n), rng.uniform(0, 200, n), rng.random(n) < (0.0 if i == 4 else 0.9), rng.integers(0, n, m), rng.integers(0, n, m), rng.uniform(10, 50, m), rng.uniform(1, 3, m)))
    joined = [np.stack(c) for c in list(zip(*alone, strict=True))[:3]]
    ends = [np.concatenate([g[e] + i * n for i, g in enumerate(alone)]) for e in (3, 4)]
    rest = [np.concatenate([g[e] for g in alone]) for e in (5, 6)]
    x, y = small_graphs.settled(small_graphs.Small(*joined, *ends, *rest), TICKS[name](), 60, 5, 0.2)
    for i, g in enumerate(alone):
        one = small_graphs.Small(*(c[None] for c in g[:3]), *g[3:])
        a, b = small_graphs.settled(one, TICKS[name](), 60, 5, 0.2)
        assert np.array_equal(a[0], x[i]) and np.array_equal(b[0], y[i])
