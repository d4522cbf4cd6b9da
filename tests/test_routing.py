import heapq
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import export, orthogonal, planar, routing
from vertexloom.sources import graphs


def boxed(spark, spots, edges, width=60.0, height=40.0):
    nodes = spark.createDataFrame([(i, float(x), float(y), width, height) for i, (x, y) in enumerate(spots)], "idx long, x double, y double, width double, height double")
    return graphs.graph(nodes, spark.createDataFrame(edges, "src long, dst long")).settled()


def apart(rng, n):
    """Places of boxes of 60 x 40 that stay 24 apart."""
    spots = []
    while len(spots) < n:
        x, y = rng.randint(0, 500), rng.randint(0, 400)
        if all(abs(x - a) >= 84 or abs(y - b) >= 64 for a, b in spots):
            spots.append((x, y))
    return spots


def segments(points):
    return list(zip(points, points[1:], strict=False))


def inside(a, b, box):
    x0, y0, x1, y1 = box
    return min(a.x, b.x) < x1 and max(a.x, b.x) > x0 and min(a.y, b.y) < y1 and max(a.y, b.y) > y0


def slow_cost(box, start, level, end, end_level, margin, bend):
    """Dijkstra over all crossings of all border lines."""
    grown = [(x0 - margin, y0 - margin, x1 + margin, y1 + margin) for x0, y0, x1, y1 in box]
    xs = sorted({start[0], end[0], *(b[0] for b in grown), *(b[2] for b in grown)})
    ys = sorted({start[1], end[1], *(b[1] for b in grown), *(b[3] for b in grown)})
    blocked = lambda x, y: any(a < x < c and b < y < d for a, b, c, d in grown)
    heap, seen = [(0.0, xs.index(start[0]), ys.index(start[1]), level)], set()
    while heap:
        cost, i, j, axis = heapq.heappop(heap)
        if (i, j, axis) in seen:
            continue
        seen.add((i, j, axis))
        if (xs[i], ys[j]) == end and axis == end_level:
            return cost
        heapq.heappush(heap, (cost + bend, i, j, not axis))
        for step in (-1, 1):
            k, m = (i + step, j) if axis else (i, j + step)
            if 0 <= k < len(xs) and 0 <= m < len(ys) and not blocked((xs[i] + xs[k]) / 2, (ys[j] + ys[m]) / 2) and not blocked(xs[k], ys[m]):
                heapq.heappush(heap, (cost + abs(xs[i] - xs[k]) + abs(ys[j] - ys[m]), k, m, axis))
    return None


def test_routes_are_cheapest_and_hit_no_box(spark):
    rng = random.Random(7)
    spots = apart(rng, 12)
    edges = sorted({tuple(rng.sample(range(12), 2)) for _ in range(16)})
    g = boxed(spark, spots, edges)
    found = {r.eid: r for r in routing.grid_routes(g, 10.0, 50.0).collect()}
    box = [(x - 30, y - 20, x + 30, y + 20) for x, y in spots]
    stubs = {(r.eid, r.end): r for r in routing._stubs(g, 10.0).collect()}
    assert len(found) == len(edges)
    for eid, r in found.items():
        a, b = stubs[eid, "src"], stubs[eid, "dst"]
        want = slow_cost(box, (a.x, a.y), a.level, (b.x, b.y), b.level, 10.0, 50.0)
        assert r.cost == pytest.approx(want + 20)
        assert (r.points[0], r.points[-1]) == (a.port, b.port)
        assert all((p.x == q.x) != (p.y == q.y) for p, q in segments(r.points))
        length = sum(abs(p.x - q.x) + abs(p.y - q.y) for p, q in segments(r.points))
        assert r.cost == pytest.approx(length + 50 * (len(r.points) - 2))
        inner = segments([type(r.points[0])(x=s.x, y=s.y) for s in (a,)] + r.points[1:-1] + [type(r.points[0])(x=s.x, y=s.y) for s in (b,)])
        assert not any(inside(p, q, (x0 - 10 + 1e-6, y0 - 10 + 1e-6, x1 + 10 - 1e-6, y1 + 10 - 1e-6)) for p, q in inner for x0, y0, x1, y1 in box)


def test_hits_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    spots = [(rng.randint(0, 300), rng.randint(0, 200)) for _ in range(14)]
    edges = sorted({tuple(rng.sample(range(14), 2)) for _ in range(20)})
    g = boxed(spark, spots, edges)
    plain = orthogonal.routes(g)
    got = sorted(map(tuple, routing.route_hits(plain, g, 3.0).select("eid", "seg", "idx").collect()))
    want = []
    ends = {r.eid: (r.src, r.dst) for r in g.edges.collect()}
    for r in plain.collect():
        for n, (p, q) in enumerate(segments(r.points)):
            if p != q:
                want += [(r.eid, n, i) for i, (x, y) in enumerate(spots) if i not in ends[r.eid] and inside(p, q, (x - 33, y - 23, x + 33, y + 23))]
    assert got == sorted(want) and want


def test_detours_where_a_box_is_in_the_way_and_loops(spark):
    g = boxed(spark, [(0, 0), (150, 0), (300, 0), (300, 200)], [(0, 2), (2, 3), (1, 1), (1, 1)])
    out = {r.eid: [(p.x, p.y) for p in r.points] for r in routing.routes_around(g).collect()}
    eids = {(r.src, r.dst, r.eid): r.eid for r in g.edges.collect()}
    around, straight = next(v for k, v in eids.items() if k[:2] == (0, 2)), next(v for k, v in eids.items() if k[:2] == (2, 3))
    assert len(out[around]) > 2 and len(out[straight]) == 2 and len(out) == 4
    routed = routing.routes_around(g)
    assert routing.route_hits(routed, g).count() == 0
    for k, eid in eids.items():
        if k[:2] == (1, 1):
            assert len(out[eid]) == 5 and out[eid][0][1] == -20 and out[eid][-1][0] == 180


def test_nudged_routes_don_t_overlap(spark):
    rng = random.Random(5)
    spots = [(x * 120, y * 100) for x in range(4) for y in range(3)]
    edges = sorted({tuple(rng.sample(range(12), 2)) for _ in range(18)})
    g = boxed(spark, spots, edges)
    before = orthogonal.routes(g)
    assert planar.lanes(planar.route_segments(before)).where("offset <> 0").count() > 0
    after = routing.nudged(before, 4.0)
    assert planar.lanes(planar.route_segments(after)).where("offset <> 0").count() == 0
    shapes = {r.eid: len(r.points) for r in before.collect()}
    for r in after.collect():
        assert len(r.points) == shapes[r.eid] and all(p.x == q.x or p.y == q.y for p, q in segments(r.points))


def test_straightened(spark):
    points = [(0, 0), (0, 0), (5, 0), (9, 0), (9, 4), (9, 4), (2, 4)]
    row = spark.createDataFrame([([tuple(map(float, p)) for p in points],)], f"points {routing.POINTS}")
    assert [tuple(p) for p in row.select(routing.straightened(F.col("points")).alias("p")).first().p] == [(0, 0), (9, 0), (9, 4), (2, 4)]


def test_orthogonal_documents_parse(spark):
    g = boxed(spark, [(0, 0), (150, 60)], [(0, 1), (1, 0)])
    g = g.with_nodes(g.nodes.withColumn("label", F.lit('a<"&')))
    plain = orthogonal.routes(g).where("eid = 0")
    svg = ET.fromstring(export.documents(export.to_svg_orthogonal(g, plain, background="#fff")).first().text)
    assert len(svg.findall("{*}polyline")) == 2 and len(svg.findall("{*}rect")) == 3 and svg.find("{*}text").text == 'a<"&'
    xml = ET.fromstring(export.documents(export.to_graphml_orthogonal(g, plain, orthogonal.ports(g))).first().text)
    edges = xml.findall(".//{*}edge")
    assert [e.find("{*}data[@key='bends']") is not None for e in edges] == [True, False] and edges[0].find("{*}data[@key='source_side']").text == "e"
    dot = export.documents(export.to_dot_orthogonal(g, plain, directed=True)).first().text
    assert dot.startswith("digraph G {") and 'comment="bends: 2"' in dot and "1 -> 0;" in dot
    assert export.to_svg_orthogonal(graphs.Graph(g.nodes.limit(0), g.edges), plain).count() == 0
