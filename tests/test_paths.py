import heapq
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.functions.geometry import segments_meet
from vertexloom.operators import force, metrics, static_layouts, traversal
from vertexloom.sources import graphs


def net(spark, rng, n, m):
    edges = sorted({tuple(rng.sample(range(n), 2)) for _ in range(m)})
    rows = [(a, b, float(rng.randint(1, 5))) for a, b in edges]
    return graphs.graph(spark.range(n).select(F.col("id").alias("idx")), spark.createDataFrame(rows, "src long, dst long, length double")).settled(), rows


def slow(n, rows, source, turn):
    near = {}
    for a, b, w in rows:
        for u, v in ((a, b), (b, a)):
            near.setdefault(u, {})[v] = min(w, near.get(u, {}).get(v, 1e9))
    heap, best, seen = [(0.0, (source,))], {source: (0.0, (source,))}, {}
    while heap:
        d, path = heapq.heappop(heap)
        state = path[-2:]
        if len(path) > 1:
            if state in seen:
                continue
            seen[state] = True
            if path[-1] not in best:
                best[path[-1]] = (d, path)
        for v, w in near.get(path[-1], {}).items():
            heapq.heappush(heap, (d + w + (turn(path[-2], path[-1], v) if len(path) > 1 else 0), (*path, v)))
    return best


def test_paths_with_turns(spark):
    rng = random.Random(6)
    g, rows = net(spark, rng, 14, 24)
    asked = spark.createDataFrame([("g", s, t) for s in (0, 5) for t in range(14)] + [("g", 3, 99)], "graph_id string, source long, target long")
    got = {(r.source, r.target): (r.dist, tuple(r.path)) for r in traversal.paths_with_turns(g, asked, lambda a, b, c: (a + 2 * b + 3 * c) % 4, "length").collect()}
    for s in (0, 5):
        want = slow(14, rows, s, lambda a, b, c: (a + 2 * b + 3 * c) % 4)
        assert {t: d for (o, t), (d, _) in got.items() if o == s} == {t: d for t, (d, _) in want.items()}
    near = {(a, b): w for a, b, w in rows}
    for (s, t), (d, path) in got.items():
        assert (path[0], path[-1]) == (s, t)
        steps = list(zip(path, path[1:], strict=False))
        cost = sum(min(near.get((a, b), 1e9), near.get((b, a), 1e9)) for a, b in steps) + sum((a + 2 * b + 3 * c) % 4 for a, b, c in zip(path, path[1:], path[2:], strict=False))
        assert cost == d


def test_shortest_path_of_a_long_chain(spark):
    rng = random.Random(2)
    g, _ = net(spark, rng, 40, 45)
    tree = traversal.distances(g, spark.createDataFrame([("g", 0)], "graph_id string, source long"), "length").collect()
    prev = {r.idx: r.prev for r in tree}
    target = max(tree, key=lambda r: r.dist).idx
    want = [target]
    while want[-1] != 0:
        want.append(prev[want[-1]])
    assert traversal.shortest_path(g, "g", 0, target, "length") == want[::-1]
    assert traversal.shortest_path(g, "g", 0, 0) == [0] and traversal.shortest_path(g, "g", 0, 77) == []


def test_runs_stop_and_resume(spark, tmp_path):
    g = graphs.graph(None, spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "src long, dst long"))
    g = g.with_nodes(static_layouts.random_layout(g, (500.0, 500.0), seed=3)).settled()
    tick = lambda nodes, t: force.spring_tick(g, nodes, damping=0.3 + 0.01 * t)
    place = lambda nodes: sorted((r.idx, r.x, r.y) for r in nodes.collect())
    whole = force.run(tick, g.nodes, 8, every=2, enough=0)
    seen = []
    force.run(tick, g.nodes, 8, every=2, enough=0, listen=lambda p: seen.append(p.tick) or p.tick >= 4, save=f"{tmp_path}/run")
    assert seen == [0, 2, 4, 4]
    on = force.resume(spark, tick, f"{tmp_path}/run", 4, every=2, enough=0, listen=lambda p: seen.append(p.tick))
    assert seen[-1] == 8
    for a, b in zip(place(whole), place(on), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("kind", ["short", "long", "grid", "upright"])
def test_crossings_are_those_of_all_pairs(spark, kind):
    rng = random.Random(kind)
    n, lines = 160, []
    for _ in range(80):
        x, y = rng.uniform(0, 100), rng.uniform(0, 60)
        if kind == "short":
            lines.append((x, y, x + rng.uniform(-4, 4), y + rng.uniform(-4, 4)))
        elif kind == "long":
            lines.append((x, y, rng.uniform(0, 100), rng.uniform(0, 60)))
        elif kind == "grid":
            a, b, c = rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 4)
            lines.append((a, b, a + c, b) if rng.random() < 0.5 else (a, b, a, b + c))
        else:
            lines.append((50.0, y, 50.0 if rng.random() < 0.5 else 50.001, y + rng.uniform(0, 20)))
    nodes = spark.createDataFrame([(2 * i + k, float(v[2 * k]), float(v[2 * k + 1])) for i, v in enumerate(lines) for k in (0, 1)], "idx long, x double, y double")
    g = graphs.graph(nodes, spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(n // 2)], "src long, dst long")).settled()
    flat = metrics.segments(g)
    p, q = flat.alias("p"), flat.alias("q")
    want = p.join(q, F.col("p.eid") < F.col("q.eid")).where(segments_meet(*metrics._ends("p", "q"))).count()
    assert metrics.edge_crossings(g).first().crossings == want and want > 0
