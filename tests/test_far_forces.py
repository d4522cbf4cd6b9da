import math
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import force, spatial
from vertexloom.sources import graphs


def placed(spark, spots, charges=None):
    rows = [("g", i, float(x), float(y), float(charges[i]) if charges else 1.0) for i, (x, y) in enumerate(spots)]
    return spark.createDataFrame(rows, "graph_id string, idx long, x double, y double, q double")


def slow(spots, charges, power, skip=0.0):
    out = []
    for i, (x, y) in enumerate(spots):
        fx = fy = 0.0
        for j, (u, v) in enumerate(spots):
            d = math.hypot(x - u, y - v)
            if d > skip:
                f = charges[i] * charges[j] / d ** (power + 1)
                fx, fy = fx + (x - u) * f, fy + (y - v) * f
        out.append((fx, fy))
    return out


def clustered(rng, n):
    spots = []
    while len(spots) < n:
        cx, cy, wide = rng.uniform(0, 1000), rng.uniform(0, 1000), rng.choice([0.5, 5, 50, 400])
        spots += [(rng.gauss(cx, wide), rng.gauss(cy, wide)) for _ in range(rng.randint(1, 80))]
    return spots[:n]


@pytest.mark.parametrize("power", [1.0, 2.0])
@pytest.mark.parametrize("kind", ["even", "clusters", "line"])
def test_error_is_below_one_percent_of_all_pairs(spark, power, kind):
    rng = random.Random(11)
    n = 700
    spots = {"even": lambda: [(rng.uniform(0, 1000), rng.uniform(0, 500)) for _ in range(n)], "clusters": lambda: clustered(rng, n), "line": lambda: [(i * 1.5, 3.0) for i in range(n)]}[kind]()
    charges = [rng.uniform(0.5, 3) for _ in range(n)]
    want = slow(spots, charges, power)
    got = {r.idx: (r.fx, r.fy) for r in spatial.interaction_forces(placed(spark, spots, charges), power, 1.0, "q", leaf=8).collect()}
    assert len(got) == n
    off = math.sqrt(sum(math.dist(got[i], want[i]) ** 2 for i in range(n)))
    assert off < 0.01 * math.sqrt(sum(math.hypot(*w) ** 2 for w in want))
    assert sum(math.dist(got[i], want[i]) for i in range(n)) < 0.01 * sum(math.hypot(*w) for w in want)


def test_every_pair_meets_once(spark):
    rng = random.Random(2)
    spots = clustered(rng, 200) + [(5.0, 5.0)] * 30 + [(900.0, 900.0)]
    nodes = placed(spark, spots)
    bodies = spatial._bodies(nodes, None)[1].join(spatial._depths(spatial._bodies(nodes, None)[1], 4), "graph_id").collect()
    depth = bodies[0].depth
    assert depth >= 3
    cells = {(level, b.cx >> (14 - level), b.cy >> (14 - level)) for b in bodies for level in range(2, depth + 1)}
    frame = spark.createDataFrame([("g", *c) for c in cells], "graph_id string, level int, cx int, cy int")
    lists = {(r.level, r.cx, r.cy, r.sx, r.sy) for r in spatial.interaction_lists(frame).collect()}
    for a in bodies:
        for b in bodies:
            met = sum((level, a.cx >> (14 - level), a.cy >> (14 - level), b.cx >> (14 - level), b.cy >> (14 - level)) in lists for level in range(2, depth + 1))
            near = abs((a.cx >> (14 - depth)) - (b.cx >> (14 - depth))) <= 1 and abs((a.cy >> (14 - depth)) - (b.cy >> (14 - depth))) <= 1
            assert met + near == 1


def test_nodes_at_one_place_and_small_graphs(spark):
    spots = [(0.0, 0.0)] * 50 + [(10.0, 0.0)] * 2
    got = {r.idx: r.fx for r in spatial.interaction_forces(placed(spark, spots), 1.0, 2.0, leaf=4).collect()}
    assert got[0] == pytest.approx(-2 * 2 / 10) and got[51] == pytest.approx(2 * 50 / 10)
    assert spatial.interaction_forces(placed(spark, [(1, 1)]), 1.0).count() == 0
    lost = placed(spark, [(1, 1), (2, 2)]).withColumn("x", F.when(F.col("idx") == 1, F.lit(None)).otherwise(F.col("x")))
    assert spatial.interaction_forces(lost).count() == 0
    close = placed(spark, [(0, 0), (0.005, 0), (4, 3)])
    got = {r.idx: (r.fx, r.fy) for r in spatial.interaction_forces(close, 1.0, 1.0, leaf=1, skip=0.01).collect()}
    want = slow([(0, 0), (0.005, 0), (4, 3)], [1, 1, 1], 1.0, 0.01)
    assert all(got[i] == pytest.approx(want[i], rel=1e-2) for i in range(3))


def test_many_graphs_don_t_act_on_each_other(spark):
    rng = random.Random(8)
    one, two = clustered(rng, 120), [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(40)]
    both = placed(spark, one).unionByName(placed(spark, two).withColumn("graph_id", F.lit("h")))
    got = {(r.graph_id, r.idx): (r.fx, r.fy) for r in spatial.interaction_forces(both, leaf=4).collect()}
    for name, spots in (("g", one), ("h", two)):
        want = slow(spots, [1] * len(spots), 1.0)
        assert sum(math.dist(got[name, i], w) for i, w in enumerate(want)) < 0.01 * sum(math.hypot(*w) for w in want)


@pytest.mark.parametrize("tick", [force.fruchterman_reingold_tick, force.spring_tick, force.force_atlas2_tick, force.yifan_hu_tick])
def test_ticks_with_lists_are_near_ticks_with_pairs(spark, tick):
    rng = random.Random(4)
    n = 150
    nodes = spark.createDataFrame([(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)], "idx long, x double, y double")
    edges = spark.createDataFrame([(i, rng.randrange(n)) for i in range(n)], "src long, dst long")
    g = graphs.graph(nodes, edges).settled()
    a = {r.idx: (r.x, r.y) for r in tick(g, g.nodes).collect()}
    b = {r.idx: (r.x, r.y) for r in tick(g, g.nodes, leaf=6).collect()}
    start = {r.idx: (r.x, r.y) for r in g.nodes.collect()}
    assert sum(math.dist(a[i], b[i]) for i in a) < 0.02 * sum(math.dist(a[i], start[i]) for i in a)


def test_tiles_don_t_change_forces(spark, monkeypatch):
    """Tiles of 2 by 2 finest cells, so that most cells and bodies that act on a tile come from beside it, and one for all."""
    rng = random.Random(8)
    rows = [(g, i, rng.gauss(0, 30), rng.uniform(0, 50), float(rng.randrange(1, 4))) for g in "ab" for i in range(400)]
    nodes = spark.createDataFrame(rows, "graph_id string, idx long, x double, y double, q double")

    def forces(tile):
        monkeypatch.setattr(spatial, "TILE", tile)
        return {(r.graph_id, r.idx): (r.fx, r.fy) for r in spatial.interaction_forces(nodes, charge="q", leaf=3).collect()}

    small, large = forces(1), forces(14)
    assert len(small) == 800 and small.keys() == large.keys()
    assert all(small[k] == pytest.approx(large[k], rel=1e-9, abs=1e-9) for k in small)
