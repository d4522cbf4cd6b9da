import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.operators import descent, orthogonal, projection
from vertexloom.sources import graphs

RULE = "graph_id string, left long, right long, gap double, equal boolean"


def line(spark, places, fixed=()):
    return spark.createDataFrame([("g", i, float(p), 0.0, int(i in fixed)) for i, p in enumerate(places)], "graph_id string, idx long, x double, y double, fixed int")


def nearest(places, rules, weights=None, rounds=40_000):
    """Hildreth's method, one constraint after the other."""
    x, w = np.array(places, float), np.array(weights or [1.0] * len(places))
    price = [0.0] * len(rules)
    for _ in range(rounds):
        moved = 0.0
        for k, (a, b, gap, equal) in enumerate(rules):
            step = (x[a] + gap - x[b]) / (1 / w[a] + 1 / w[b])
            step = step if equal else max(-price[k], step)
            price[k] += step
            x[a] -= step / w[a]
            x[b] += step / w[b]
            moved = max(moved, abs(step))
        if moved < 1e-11:
            break
    return x


def projected(spark, places, rules, fixed=()):
    frame = spark.createDataFrame([("g", *r) for r in rules], RULE)
    return {r.idx: r.x for r in projection.project(line(spark, places, fixed), frame, "x").collect()}


def test_places_are_the_nearest_that_meet_all_gaps(spark):
    rng = random.Random(1)
    n = 6
    places = [rng.uniform(0, 50) for _ in range(n)]
    rules = [(a, b, rng.uniform(0, 12), False) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5 and (a, b) not in ((0, 1), (4, 5))]
    rules += [(0, 1, 3.0, True), (4, 5, 2.0, True)]
    fixed = (2,)
    got = projected(spark, places, rules, fixed)
    want = nearest(places, rules, [1000.0 if i in fixed else 1.0 for i in range(n)])
    assert all(got[b] - got[a] >= gap - 1e-9 for a, b, gap, equal in rules)
    assert all(got[b] - got[a] == pytest.approx(gap, abs=1e-9) for a, b, gap, equal in rules if equal)
    assert all(got[i] == pytest.approx(want[i], abs=1e-2) for i in range(n))


def test_stars_of_many_leaves_settle_in_few_rounds(spark):
    """Two hubs with 300 leaves to the right of one and to the left of the other: five rounds are enough."""
    rng = random.Random(4)
    places = [50.0, 60.0] + [float(rng.randrange(100)) for _ in range(600)]
    rules = [(0, i, 9.0, False) for i in range(2, 302)] + [(i, 1, 9.0, False) for i in range(302, 602)]
    frame = spark.createDataFrame([("g", *r) for r in rules], "graph_id string, left long, right long, gap double, equal boolean")
    got = {r.idx: r.x for r in projection.project(line(spark, places), frame, "x", tolerance=1e-6, rounds=5, every=5).collect()}
    for hub, sign, leaves in ((0, 1, range(2, 302)), (1, -1, range(302, 602))):
        near = np.array(sorted(sign * places[i] - 9.0 for i in leaves))
        sums = (sign * places[hub] + np.concatenate([[0.0], np.cumsum(near)])) / np.arange(1, 302)
        at = sums.min()
        assert got[hub] == pytest.approx(sign * at, abs=1e-4)
        assert all(got[i] == pytest.approx(sign * max(sign * places[i], at + 9.0), abs=1e-4) for i in leaves)


def test_nothing_moves_where_all_gaps_are_met(spark):
    places = [0.0, 10.0, 25.0, -3.5]
    assert projected(spark, places, [(0, 1, 10.0, False), (1, 2, 3.0, False), (3, 0, 0.0, None)]) == dict(enumerate(places))
    assert projected(spark, places, []) == dict(enumerate(places))
    assert projected(spark, places, [(0, 99, 5.0, False), (1, 1, 0.0, False)]) == dict(enumerate(places))


def test_contradictions_are_refused(spark):
    for rules in ([(0, 1, 5.0, True), (1, 2, 5.0, True), (0, 2, 11.0, True)], [(0, 1, 5.0, True), (1, 0, -4.0, False)], [(1, 1, 2.0, False)]):
        with pytest.raises(projection.ContradictionError):
            projected(spark, [0, 1, 2], rules)
    frame = spark.createDataFrame([("g", 0, 1, 5.0, False), ("g", 1, 0, 5.0, False)], RULE)
    with pytest.raises(projection.ContradictionError):
        projection.project(line(spark, [0, 1]), frame, "x", rounds=20)


def test_alignments_share_nodes(spark):
    members = spark.createDataFrame([("g", 1, 0, 0.0), ("g", 1, 3, 4.0), ("g", 2, 3, 0.0), ("g", 2, 5, 1.0), ("g", 3, 1, 0.0), ("g", 3, 2, 0.0)], "graph_id string, aid long, idx long, offset double")
    tied = {r.idx: (r.root, r.offset) for r in projection.classes(line(spark, range(6)), projection.alignments(members)).collect()}
    assert tied == {0: (0, 0.0), 3: (0, 4.0), 5: (0, 5.0), 1: (1, 0.0), 2: (1, 0.0), 4: (4, 0.0)}


class Slow:
    """Descent with whole matrices."""

    def __init__(self, x, d, goal):
        self.x, self.d, self.goal = x, d, goal

    def derivatives(self, x):
        diff = x[:, :, None] - x[:, None, :]
        length = np.sqrt((diff**2).sum(axis=0))
        count = (length > 0) & (self.d > 0) & np.isfinite(self.d) & ~((self.goal > 1) & (length > self.d))
        d, l, w = np.where(count, self.d, 1), np.where(count, length, 1), np.minimum(self.goal, 1)  # noqa: E741
        g = (diff * np.where(count, 2 * w * (l - d) / (d * d * l), 0)).sum(axis=2)
        h = np.where(count, -2 * w / (d * d * l**3), 0) * (2 * l**3 + d * (diff**2 - l * l))
        for k in range(2):
            np.fill_diagonal(h[k], 0)
            np.fill_diagonal(h[k], -h[k].sum(axis=1))
        return g, h

    def to(self, x):
        g, h = self.derivatives(x)
        below = sum(g[k] @ h[k] @ g[k] for k in range(2))
        return x - ((g * g).sum() / below if below else 0) * g

    def runge_kutta(self):
        a = self.to(self.x)
        b = self.to((self.x + a) / 2)
        c = self.to((self.x + b) / 2)
        self.x = (a + 2 * b + 2 * c + self.to(c)) / 6


def ring(spark, n=8):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(n)], "idx long, x double, y double")
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    return graphs.graph(nodes, edges).settled()


def test_steps_are_those_of_matrices_and_stress_falls(spark):
    g = ring(spark)
    n = 8
    ideal = descent.ideal_distances(g)
    d, goal = np.zeros((n, n)), np.ones((n, n))
    for r in ideal.collect():
        d[r.i, r.j], goal[r.i, r.j] = r.d, r.goal
    own = Slow(np.array([[r.x, r.y] for r in g.nodes.orderBy("idx").collect()]).T, d, goal)
    state, stress = g.nodes, [descent.stress(g.nodes, ideal).first().stress]
    for _ in range(3):
        state = descent.runge_kutta(state, ideal)
        own.runge_kutta()
        got = np.array([[r.x, r.y] for r in state.orderBy("idx").collect()]).T
        assert np.allclose(got, own.x, rtol=1e-7)
        stress.append(descent.stress(state, ideal).first().stress)
    assert stress == sorted(stress, reverse=True) and stress[-1] < 0.6 * stress[0]


def test_anchors_pull_and_fixed_nodes_stay(spark):
    g = ring(spark)
    held = g.with_nodes(g.nodes.withColumn("fixed", F.when(F.col("idx") == 1, 1).otherwise(0)))
    ideal = descent.ideal_distances(g)
    anchors = spark.createDataFrame([("g", 0, -500.0, 40.0)], "graph_id string, idx long, ax double, ay double")
    out = {r.idx: (r.x, r.y) for r in descent.descend(held.nodes, ideal, 6, anchors=anchors, stages=1).collect()}
    before = {r.idx: (r.x, r.y) for r in g.nodes.collect()}
    assert out[1] == before[1]
    assert abs(out[0][0] + 500) < 0.7 * abs(before[0][0] + 500)


def test_layout_meets_constraints_and_keeps_boxes_apart(spark):
    g = ring(spark, 6)
    g = g.with_nodes(g.nodes.withColumn("width", F.lit(70.0)).withColumn("height", F.lit(50.0)))
    rules = spark.createDataFrame([("g", "y", 0, 1, 60.0, False), ("g", "x", 2, 3, 0.0, True)], "graph_id string, axis string, left long, right long, gap double, equal boolean")
    out = descent.constrained_layout(g, edge_length=60.0, constraints=rules, gap=5.0, unconstrained=2, constrained=1, apart=1)
    at = {r.idx: r for r in out.collect()}
    assert at[1].y - at[0].y >= 60 - 1e-3 and at[2].x == pytest.approx(at[3].x, abs=1e-6)
    assert orthogonal.neighbours_along(out, "x").join(orthogonal.neighbours_along(out, "y").select("left", "right"), ["left", "right"]).count() == 0
    for a in at.values():
        for b in at.values():
            if a.idx < b.idx:
                assert abs(a.x - b.x) >= 70 - 1e-3 or abs(a.y - b.y) >= 50 - 1e-3


def test_groups_hold_their_members_and_keep_apart(spark):
    from vertexloom.operators import grouping

    rng = random.Random(5)
    rows = [("g", i, rng.uniform(0, 160), rng.uniform(0, 160), 20.0, 14.0, 0) for i in range(9)]
    nodes = spark.createDataFrame(rows, "graph_id string, idx long, x double, y double, width double, height double, fixed int")
    groups = spark.createDataFrame([("g", 0, [0, 1, 2], []), ("g", 1, [3, 4], []), ("g", 2, [5], [1])], "graph_id string, gid long, leaves array<long>, children array<long>")
    out = grouping.with_groups_apart(nodes, groups, padding=4.0, gap=2.0)
    at = {r.idx: (r.x - 10, r.y - 7, r.x + 10, r.y + 7) for r in out.collect()}
    box = lambda parts: (min(p[0] for p in parts) - 4, min(p[1] for p in parts) - 4, max(p[2] for p in parts) + 4, max(p[3] for p in parts) + 4)
    inner = box([at[3], at[4]])
    tops = [box([at[0], at[1], at[2]]), box([at[5], inner]), *(at[i] for i in (6, 7, 8))]
    apart = lambda a, b: a[2] + 2 <= b[0] + 1e-6 or b[2] + 2 <= a[0] + 1e-6 or a[3] + 2 <= b[1] + 1e-6 or b[3] + 2 <= a[1] + 1e-6
    assert all(apart(a, b) for i, a in enumerate(tops) for b in tops[i + 1 :])
    assert apart(at[5], inner) and all(apart(at[a], at[b]) for a, b in ((0, 1), (0, 2), (1, 2), (3, 4)))
