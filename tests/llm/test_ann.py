import math

import numpy as np
import pytest

from vertexloom.llm import ann as A


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def exact(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, q in good:
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def rows(n=3000, scale=False):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 2
    x = centres[rng.integers(20, size=n)] + rng.standard_normal((n, 16))
    if not scale:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(5000 + i, out[7][1]) for i in range(100)]
    return out + [(9000, None), (9020, [0.0] * 16), (9040, [math.nan] + [1.0] * 15), (9060, [None] + [1.0] * 15), (9080, [math.inf] + [1.0] * 15), (9100, [1.0] * 3), (None, [1.0] * 16), (20, out[20][1])]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, scale):
    data = rows(scale=scale)
    got = {}
    for r in A.search(frame(spark, data), leaf_rows=50, shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact(data)
    assert set(got) == set(want)
    x = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in data if v is not None and None not in v}
    hits = 0
    for q, own in got.items():
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in [r.vec_id for r in own]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(float(x[q] @ x[r.vec_id]), rel=1e-12, abs=1e-12)
        hits += len({r.vec_id for r in own} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("shard_rows", [30, 32_768])
def test_all_leaves_give_the_exact_answer(spark, shard_rows):
    data = rows(400)
    got = {}
    for r in A.search(frame(spark, data), share=1.0, leaf_rows=20, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: [(i, pytest.approx(s)) for i, s in own] for q, own in exact(data).items()}


def test_small_and_empty_tables(spark):
    assert A.search(frame(spark, [])).count() == 0
    assert A.search(frame(spark, [(0, None)])).count() == 0
    assert A.search(frame(spark, [(0, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in A.search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()] == [(0, 1, 1, 5.0)]
