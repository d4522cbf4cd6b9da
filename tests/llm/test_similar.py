import random

import pytest

import corpus_pipeline
from vertexloom.llm import similar as S


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    top = {i: i for i, *_ in rows if i is not None}
    sets = [(i, grams(t)) for i, t, *_ in rows if i is not None]
    near = lambda x, y: len(x & y) * 5 >= 4 * len(x | y)
    changed = True
    pairs = [(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[:n] if near(x, y)]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(top[i], top[j])
            changed |= top[i] != low or top[j] != low
            top[i] = top[j] = low
    return sorted(i for i in top if top[i] == i), pairs


def test_near_copies_at_four_fifths_go(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(900)}"
    rows = [(1, None, "k"), (2, " ", "k"), (3, "a b", "k"), (4, "A b", "k"), (5, "a c", "k"), (None, "a b", "k")]
    for i in range(40):
        base = [word() for _ in range(rng.randint(14, 160))]
        rows.append((100 + 10 * i, " ".join(base), "k"))
        for k in range(1, 5 if i else 10):
            other = list(base)
            for _ in range(max(1, len(base) * k // 100)):
                other[rng.randrange(len(other))] = word()
            rows.append((100 + 10 * i + k, " ".join(other), "k"))
    want, pairs = expected(rows)
    assert len(pairs) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 1


def test_large_groups_and_a_passage_that_many_share(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    rows = []
    for i in range(150):  # one group of near copies, in chains
        other = list(base)
        for _ in range(rng.randrange(4)):
            other[rng.randrange(90)] = word()
        rows.append((i, " ".join(other), "k"))
    for i in range(200, 350):  # a shared passage alone makes no link, but with little besides it does
        rows.append((i, " ".join([word() for _ in range(rng.choice([4, 30, 90]))] + passage), "k"))
    want, pairs = expected(rows)
    assert len(pairs) > 2000
    assert sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()) == want
    monkeypatch.setattr(S, "GROUP", 3)
    monkeypatch.setattr(S, "BLOCK", 100)
    assert sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()) == want


def test_columns_copies_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i * i % 7919}" for i in range(30_000))
    rows = [(5, text, "k", 1), (5, text, "k", 1), (2, text.upper(), "k", 2), (9, "other words " * 9, None, 3), (None, text, "n", 4), (11, long, "k", 1), (12, long + " end", "k", 1)]
    out = S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, th string, __bucket int"))
    assert out.columns == ["doc_id", "text", "th", "__bucket"]
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [2, 9, 11]
    assert out.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert S.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_fingerprint_of_a_set(n):
    own = S.shingles(" ".join(f"w{i}" for i in range(n)), 5)
    bits = [sum((int(h) >> b) & 1 for h in own) * 2 > len(own) for b in range(64)]
    assert S.print_of(own) % 2**64 == sum(1 << b for b, one in enumerate(bits) if one)
