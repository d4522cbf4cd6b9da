import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_trees import brute_blocks, counted, many, samples

from vertexloom.operators import cores, planar


def orders(rng, n, parts, first, most=6):
    """Edges from n orders to some of the parts; nodes are numbered from first on, parts before orders."""
    return [(first + parts + i, first + p) for i in range(n) for p in rng.sample(range(parts), rng.randint(1, most))]


def check(spark, sets):
    got = defaultdict(dict)
    for r in planar.blocks(many(spark, sets), large=1).collect():
        assert r.eid not in got[r.graph_id]
        got[r.graph_id][r.eid] = r.block
    for i, edges in enumerate(sets):
        assert got[str(i)] == brute_blocks([(e, a, b) for e, (a, b) in enumerate(edges)]), i


def test_blocks_by_a_core_against_a_depth_first_search(spark):
    """Two crowds that one node, or two edges, or none hold together, with rings, chains, twins and a loop beside them."""
    rng, sets = random.Random(3), []
    for links in ([], [(5, 1005)], [(5, 1005), (9, 1011)], [(5, 1005), (5, 1005)], [(5, 3000), (3000, 3001), (3001, 1009), (40, 3001)]):
        edges = orders(rng, 500, 60, 0) + orders(rng, 700, 80, 1000) + links
        edges += [(7, 4000), (4000, 4001), (4001, 7), (8, 4010), (4010, 4011), (4011, 12), (4011, 4012), (4012, 4013), (20, 4020), (4020, 20), (21, 21)]
        rng.shuffle(edges)
        sets.append(edges)
    check(spark, sets)


@pytest.mark.parametrize("one_in", [2, 3])
def test_any_core_gives_the_same_blocks(spark, monkeypatch, one_in):
    """Whatever nodes are in the core and however small its blocks are."""
    monkeypatch.setattr(cores, "_core", lambda inner, degrees: lambda node, degree: F.pmod(F.xxhash64(node), F.lit(one_in)) == 0)
    monkeypatch.setattr(cores, "LEAST", 2)
    rng = random.Random(17 + one_in)
    sets = samples() + [orders(rng, 30, 12, 0, 3) for _ in range(6)] + [[(rng.randrange(25), rng.randrange(25)) for _ in range(70)] for _ in range(6)]
    check(spark, sets)


def test_long_loops_get_a_part_of_a_large_block(spark, monkeypatch):
    edges = orders(random.Random(9), 3000, 300, 0)
    rows, seen = counted(monkeypatch), []
    found = planar._blocks
    monkeypatch.setattr(planar, "_blocks", lambda df: seen.append(df.count()) or found(df))
    got = {r.eid: r.block for r in planar.blocks(many(spark, [edges]), large=1).collect()}
    assert got == brute_blocks([(e, a, b) for e, (a, b) in enumerate(edges)])
    assert len(seen) == 2 and sum(seen) < 0.2 * len(edges) and sum(rows) < 4 * len(edges)
