import random

from pyspark.sql import functions as F

from vertexloom.operators import planar, polygons


def scene(spark, rng, n):
    rows = []
    for k in range(n):
        cx, cy, wide = rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(2, 14)
        rows += [(str(k), i, cx + rng.gauss(0, wide), cy + rng.gauss(0, wide)) for i in range(12)]
    spots = spark.createDataFrame(rows, "graph_id string, idx long, x double, y double")
    hull = planar.convex_hull(spots)
    corners = hull.withColumn("polygon", F.col("graph_id").cast("int")).withColumn("graph_id", F.lit("g"))
    found = {}
    for r in corners.orderBy("polygon", "pos").collect():
        found.setdefault(r.polygon, []).append((r.x, r.y))
    return corners, found


def cross(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def meet(p, q, r, s):
    return cross(p, q, r) * cross(p, q, s) <= 0 and cross(r, s, p) * cross(r, s, q) <= 0


def sides(v):
    return list(zip(v, v[1:] + v[:1], strict=True))


def test_tangents_visibility_and_overlap_are_those_of_brute_force(spark):
    rng = random.Random(4)
    corners, poly = scene(spark, rng, 8)
    want, seen, both = set(), set(), set()
    for a in poly:
        for b in poly:
            if a >= b:
                continue
            inside = lambda p, v: len({cross(s, t, p) > 0 for s, t in sides(v)}) == 1
            if any(meet(*s, *t) for s in sides(poly[a]) for t in sides(poly[b])) or inside(poly[a][0], poly[b]) or inside(poly[b][0], poly[a]):
                both.add((a, b))
            for p in poly[a]:
                for q in poly[b]:
                    one = {cross(p, q, r) > 0 for r in poly[a] if r != p}
                    two = {cross(p, q, r) > 0 for r in poly[b] if r != q}
                    if len(one) == len(two) == 1:
                        row = (a, b, *p, *q, "rl"[one.pop()] + "rl"[two.pop()])
                        want.add(row)
                        if not any(meet(p, q, *s) for c in poly if c not in (a, b) for s in sides(poly[c])):
                            seen.add(row)
    found = polygons.tangents(corners)
    columns = ("a", "b", "ax", "ay", "bx", "by", "kind")
    assert {tuple(r) for r in found.select(*columns).collect()} == want and len(want) > 60
    assert {tuple(r) for r in polygons.visible(found, corners).select(*columns).collect()} == seen and 0 < len(seen) < len(want)
    assert {(r.a, r.b) for r in polygons.overlaps(corners).collect()} == both and both
    apart = [k for k in [(a, b) for a in poly for b in poly if a < b] if k not in both]
    for a, b in apart:
        assert sorted(w[-1] for w in want if w[:2] == (a, b)) == ["ll", "lr", "rl", "rr"]


def test_points_and_lines_have_no_tangents(spark):
    rows = [("g", 0, 0, 0.0, 0.0), ("g", 1, 0, 5.0, 5.0), ("g", 1, 1, 6.0, 5.0), ("g", 2, 0, 9.0, 0.0), ("g", 2, 1, 9.0, 2.0), ("g", 2, 2, 8.0, 1.0)]
    corners = spark.createDataFrame(rows, "graph_id string, polygon int, pos int, x double, y double")
    assert polygons.tangents(corners).count() == 0 and polygons.overlaps(corners).count() == 0
