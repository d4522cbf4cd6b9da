import random
from collections import defaultdict

from vertexloom.operators import planar, trees
from vertexloom.sources import graphs


def brute_blocks(edges):
    """eid -> least eid of its block; edges (eid, src, dst). Depth first with a stack of edges; loops are left out."""
    at = defaultdict(list)
    for e, a, b in edges:
        if a != b:
            at[a].append((e, b))
            at[b].append((e, a))
    seen, low, out, held, clock = {}, {}, {}, [], 0
    for root in at:
        if root in seen:
            continue
        seen[root] = low[root] = clock = clock + 1
        walk = [(root, None, iter(at[root]))]
        while walk:
            v, by, rest = walk[-1]
            for e, w in rest:
                if e == by:
                    continue
                if w not in seen:
                    held.append(e)
                    seen[w] = low[w] = clock = clock + 1
                    walk.append((w, e, iter(at[w])))
                    break
                if seen[w] < seen[v]:
                    held.append(e)
                    low[v] = min(low[v], seen[w])
            else:
                walk.pop()
                if walk:
                    u = walk[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= seen[u]:
                        block = [held.pop()]
                        while block[-1] != by:
                            block.append(held.pop())
                        out.update(dict.fromkeys(block, min(block)))
    return out


def many(spark, sets):
    rows = [(str(i), e, a, b) for i, edges in enumerate(sets) for e, (a, b) in enumerate(edges)]
    return graphs.graph(None, spark.createDataFrame(rows, "graph_id string, eid long, src long, dst long"))


def samples():
    rng = random.Random(11)
    sets = []
    for n, m in ((2, 3), (3, 2), (5, 5), (8, 9), (12, 12), (12, 20), (30, 32), (60, 62), (60, 75)):
        sets += [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for _ in range(4)]
    sets.append([(0, i) for i in range(1, 40)] + [(3, 4), (9, 17)])  # a hub
    sets.append([(i, i + 1) for i in range(1500)] + [(10, 700), (650, 900), (1200, 1201), (1300, 1450)])  # a long path
    sets.append([(2, 2)])
    return sets


def test_blocks_against_a_depth_first_search(spark):
    sets = samples()
    got = defaultdict(dict)
    for r in planar.blocks(many(spark, sets)).collect():
        assert r.eid not in got[r.graph_id]
        got[r.graph_id][r.eid] = r.block
    for i, edges in enumerate(sets):
        assert got[str(i)] == brute_blocks([(e, a, b) for e, (a, b) in enumerate(edges)]), (i, edges)


def test_forests_tours_and_values_below(spark):
    sets = [s for s in samples() if len(s) > 4][:12]
    g = many(spark, sets)
    tree, labels = trees.spanning_forest(g.edges)
    tour = trees.tours(g.edges.join(tree, ["graph_id", "eid"]), labels)
    values = labels.selectExpr("graph_id", "node", "node * 7 % 11 AS low", "node * 7 % 11 AS high")
    found = {(r.graph_id, r.node): (r.low, r.high) for r in trees.below(tour, values).collect()}
    rows, roots = tour.collect(), {(r.graph_id, r.node): r.root for r in labels.collect()}
    # as many edges as nodes without the roots; both ends have one root, and each component has one
    assert len(rows) == len(roots) - len({(g_, r) for (g_, _), r in roots.items()}) == tree.count()
    for i, edges in enumerate(sets):
        assert all(roots[str(i), a] == roots[str(i), b] for a, b in edges if a != b)
    up = {(r.graph_id, r.node): r for r in rows}
    assert len(up) == len(rows) and sorted((r.graph_id, r.root, p) for r in rows for p in (r.first, r.last)) == sorted((g_, r, p) for g_, r in {(r.graph_id, r.root) for r in rows} for p in range(2 * sum(x.graph_id == g_ and x.root == r for x in rows)))
    under = defaultdict(list)
    for r in rows:
        above = r
        while above is not None:  # the node counts for itself and for all on its way to the root
            under[above.graph_id, above.node].append(r.node * 7 % 11)
            assert above.first <= r.first and r.last <= above.last
            above = up.get((above.graph_id, above.parent))
    assert found == {k: (min(v), max(v)) for k, v in under.items()}


def test_no_edges(spark):
    assert planar.blocks(many(spark, [[(2, 2)]])).count() == 0
    assert planar.bridges(many(spark, [[(2, 2), (3, 3)]])).count() == 0


def counted(monkeypatch):
    """How many rows the tables of loops get from now on."""
    rows = []

    class Counting(trees.Rounds):
        def __call__(self, df):
            out = super().__call__(df)
            rows.append(out.count())
            return out

    monkeypatch.setattr(trees, "Rounds", Counting)
    return rows


def test_values_below_on_long_tours_take_no_round_of_all_places(spark, monkeypatch):
    rng = random.Random(5)
    n = 9000
    tour = [("path", 0, i, i - 1, i, i - 1, 2 * n - i) for i in range(1, n + 1)]  # below i is all that follows
    tour += [("star", 7, i, 7, 10 + i, 2 * i, 2 * i + 1) for i in range(3000)]
    value = {(t[0], t[4]): sorted(rng.sample(range(10**6), 2)) for t in tour}
    frame = spark.createDataFrame(tour, "graph_id string, root long, eid long, parent long, node long, first long, last long")
    values = spark.createDataFrame([(*k, *v) for k, v in value.items()], "graph_id string, node long, low long, high long")
    rows = counted(monkeypatch)
    got = {(r.graph_id, r.node): [r.low, r.high] for r in trees.below(frame, values).collect()}
    low, high = 10**9, -1
    for i in range(n, 0, -1):
        low, high = min(low, value["path", i][0]), max(high, value["path", i][1])
        value["path", i] = [low, high]
    assert got == value and sum(rows) < 2 * n


def test_ranks_take_few_rounds_of_all_darts(spark, monkeypatch):
    order = random.Random(6).sample(range(10**6), 5000)
    darts = [("a", d, after, int(after is not None)) for d, after in zip(order, [*order[1:], None], strict=True)]
    rows = counted(monkeypatch)
    got = trees._ranked(spark.createDataFrame(darts, "graph_id string, dart long, next long, left long")).collect()
    assert {r.dart: r.left for r in got} == {d: len(order) - 1 - i for i, d in enumerate(order)}
    assert sum(rows) < 7.5 * len(order)  # doubling all of them takes 9 tables of all
