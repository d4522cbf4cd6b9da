import math
import random
from collections import Counter

import pytest

from vertexloom.llm import mixing as M


def edf(shares, blocks):
    """Slot by slot: of the released blocks the one with the earliest deadline, ties to the first source."""
    period = sum(shares.values())
    order = sorted(shares, key=lambda s: (s is None, s or ""))
    done, slots, t = Counter(), [], 0
    while len(slots) < sum(blocks.values()):
        ready = [(-(-(done[s] + 1) * period // shares[s]), i) for i, s in enumerate(order) if done[s] < blocks[s] and done[s] * period // shares[s] <= t]
        if ready:
            s = order[min(ready)[1]]
            slots.append((s, shares[s], period, done[s], t))
            done[s] += 1
        t += 1
    return slots


WEIGHTS = [
    {"a": 1.0},
    {"a": 0.7, "b": 0.2, None: 0.1},
    {"hot": math.sqrt(1 / 3)} | {f"s{i}": math.sqrt(2 / 57) for i in range(19)},  # a third of the rows, and 19 alike
    {"a": math.pi, "b": math.e, "c": 1e-3, "d": math.sqrt(2), "e": 1e-6},
]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_keeps_every_source_within_a_block_of_its_weight(spark, weights):
    shares = dict(zip(weights, M.whole_weights(list(weights.values())), strict=True))
    blocks = {s: 1 + int(5000 * w / sum(weights.values())) for s, w in weights.items()}
    rows = [(s, shares[s], blocks[s]) for s in weights]
    got = sorted(map(tuple, M.schedule(spark.createDataFrame(rows, "source string, share long, blocks long")).collect()), key=lambda r: r[4])
    assert got == edf(shares, blocks)
    total, done = sum(weights.values()), Counter()
    taken = {slot: s for s, *_, slot in got}
    for t in range(max(taken) + 1):
        if t in taken:
            done[taken[t]] += 1
        assert all(done[x] == blocks[x] or abs(done[x] - w / total * (t + 1)) < 1 for x, w in weights.items())


def test_a_source_that_outlasts_the_others_waits_for_its_slots(spark):
    rows = [("a", 1, 20), ("b", 3, 6)]
    got = sorted(r.slot for r in M.schedule(spark.createDataFrame(rows, "source string, share long, blocks long")).collect() if r.source == "a")
    assert all(4 * k <= slot < 4 * k + 4 for k, slot in enumerate(got)) and len(got) == 20


def test_whole_weights():
    assert M.whole_weights([0.2, 0.5, 0.05, 3.0]) == [4, 10, 1, 60]
    assert M.whole_weights([math.pi, 1e-30]) == [M.UNIT, 1]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n int, u string, rows int")


def rows():
    rng = random.Random(1)
    out = [(i, "hot" if i % 3 else rng.choice(["a", "b", "c", None]), "t", 1, "x", 2) for i in range(3000)]
    return out + [(None, "a", "t", 1, "x", 2), (None, None, None, 1, "x", 2), (7, "hot", "t", 1, "x", 2), (7, "hot", "t", 1, "x", 2)]


@pytest.mark.parametrize("weights", [None, {"hot": 0.2, "a": 0.5, "b": 0.2, "c": 0.05}])
def test_every_row_has_one_place(spark, weights):
    data = rows()
    out = M.mix(frame(spark, data), weights=weights, default_weight=0.05, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in data)
    sizes = Counter(r[1] for r in data)
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.block), []).append(r)
    for s, n in sizes.items():
        assert {b for x, b in blocks if x == s} == set(range(1, math.ceil(n / 8) + 1))
    slots = {}
    for (s, b), own in blocks.items():
        assert sorted(r.place for r in own) == list(range(len(own))) and (len(own) == 8 or b == math.ceil(sizes[s] / 8))
        assert len({(r.slot, r.released, r.due) for r in own}) == 1 and own[0].released <= own[0].slot < own[0].due
        assert slots.setdefault(own[0].slot, s) == s
    # until a source runs out it has its share of blocks, give or take less than one
    raw = {s: (weights or {}).get(s, 0.05) if weights else math.sqrt(n) for s, n in sizes.items()}
    done, total = Counter(), {s: math.ceil(n / 8) for s, n in sizes.items()}
    for t in range(max(slots) + 1):
        if t in slots:
            done[slots[t]] += 1
        for s in sizes:
            assert done[s] == total[s] or abs(done[s] - raw[s] / sum(raw.values()) * (t + 1)) < 1 - 1e-12


def test_larger_tables_have_larger_blocks(spark):
    out = M.mix(frame(spark, rows()), block_rows=8, max_blocks=50).collect()
    assert max(r.place for r in out) == math.ceil(len(rows()) / 50) - 1 and len({r.slot for r in out}) <= 50 + 5


def test_a_doc_id_that_many_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 100)
    data = rows() + [(5, "hot", "t", 1, "x", 2)] * 1234 + [(None, "hot", "t", 1, "x", 2)] * 321
    out = M.mix(frame(spark, data), block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in data)
    assert len({(r.source, r.block, r.place) for r in out}) == len(data)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1, 2, 3), (2, None, "y", 4, 5, 6)], "doc_id long, source string, row string, at int, slot int, times int")
    out = M.mixed(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a", "x", 1, 2, 3), (2, None, "y", 4, 5, 6)]


def test_rows_come_in_order(spark):
    docs = frame(spark, rows())
    out = M.mixed(docs, block_rows=8)
    assert out.columns == docs.columns and out.count() == docs.count()
    places = {(r.doc_id, r.source): (r.slot, r.place) for r in M.mix(docs, block_rows=8).collect()}
    got = [places[r.doc_id, r.source] for r in out.collect() if r.doc_id not in (7, None)]
    assert got == sorted(got)


def test_limits(spark):
    docs = frame(spark, rows())
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, weights={"a": 0})
    with pytest.raises(Exception, match="more than 2 sources"):
        M.mix(docs, max_sources=2).collect()


def test_the_run_is_planned_once(spark):
    docs = frame(spark, [(i, "ab"[i % 2], "", 0, "", 0) for i in range(40)])
    plan = M.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan
