import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from vertexloom.llm import lm_scoring as M


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = [rng.choice(vocab)]
        for _ in range(rng.randint(0, 80)):
            w.append(vocab[(int(w[-1][1:]) * 7 + rng.randint(0, 2)) % 60] if rng.random() < 0.8 else rng.choice(vocab))
        rows.append((i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, "w1 W2"), (7, "w1 w2"), (7, "w1 w2"), (1003, "É unseen " * 700)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, count int")


def expected(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*words(t), None]
        out.append((i, h, len(tokens), sum(w in train for w in tokens), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def mean(count, base=1.5):
    """The mean of the level that the count lies in."""
    if not count:
        return 0.0
    q = 1
    while math.ceil(base**q - 1e-9) <= count:
        q += 1
    return (math.ceil(base ** (q - 1) - 1e-9) + max(math.ceil(base ** (q - 1) - 1e-9), math.ceil(base**q - 1e-9) - 1)) / 2


def slow_scores(rows, mu=100.0):
    """log10 probabilities from exact counts, put through the level means; no filter."""
    train = [[*words(t), None] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    single = Counter(w for t in train for w in t)
    pairs = Counter((h, w) for t in train for h, w in zip([None, *t], t, strict=False))
    mass, sums = sum(map(mean, single.values())), Counter()
    for (h, _), c in pairs.items():
        sums[h] += mean(c)
    p = lambda w: (mean(single[w]) + 1) / (mass + len(single) + 1)
    joint = lambda h, w: (mean(pairs[h, w]) + mu * p(w)) / (sums[h] + mu)
    assert abs(sum(map(p, single)) + p("unknown") - 1) < 1e-9
    for h in [None, *list(single)[:5]]:
        assert abs(sum(joint(h, w) for w in single) + joint(h, "unknown") - 1) < 1e-9
    return [sum(math.log10(joint(h, w)) for h, w in zip([None, *words(t)], [*words(t), None], strict=True)) for _, t in rows]


WAYS = [{}, {"max_bits": 0}, {"max_vocabulary": 0}]


@pytest.mark.parametrize("way", WAYS)
def test_base_scores_and_scores(spark, way, monkeypatch):
    monkeypatch.setattr(M, "COUNTED", 3000)
    rows = corpus()
    # with 40 bits a key the filter makes no mistake here, and the scores are those of the quantised counts
    got = M.score_documents(frame(spark, rows), bits_per_key=40, segment_bytes=10_000, **way).collect()
    want = [(*e[:5], round(e[5], 6), round(s, 6)) for e, s in zip(expected(rows), slow_scores(rows), strict=True)]
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, got)), key=str) == sorted(want, key=str)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_all_ways_give_the_same_scores(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(150))) for i in range(1500)]
    rows += [(i, rows[i % 50][1]) for i in range(2000, 2100)] + [(None, None), (2101, "")]
    docs = frame(spark, rows)
    each = [sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in M.score_documents(docs, segment_bytes=100_000, **way).collect()) for way in WAYS]
    assert len(each[0]) == len(rows) and each[0] == each[1] == each[2]


def model(spark, rows, **shape):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = M.count_words(docs).toPandas()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    own = M.Words(key[order], np.append(found["count"].to_numpy()[order], 0), int(found["count"].sum()), 100.0)
    shape = M.Shape(**shape)
    filter_ = M.build_filter(docs, M.count_words(docs), spark.sparkContext.broadcast(own), shape)
    own = own.with_filter(*M.word_values(filter_, own.n), shape.means)
    own.means = shape.means
    sizes, bits = [0] * shape.number, [b""] * shape.number
    for r in filter_.collect():
        sizes[r.segment], bits[r.segment] = r.size, bytes(r.bits)
    return own, shape, M.LogBloom.of(shape, sizes, bits)


def test_probabilities_add_up_to_one_but_for_the_filters_errors(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([20, 300, 3000])]) for _ in range(200))) for i in range(600)]
    own, shape, bloom = model(spark, rows, number=7)
    w = np.arange(own.n + 1)
    assert abs(own.single(w, own.means).sum() - 1) < 0.01
    for h in range(0, own.n, 300):
        hs = np.full(own.n, h)
        a, b = own.known[hs], own.known[w[:-1]]
        level = np.append(bloom.highest(M.pair_key(a, b), M.pair_segment(a, b, shape.number)), 0)
        total = (10 ** own.joint(np.full(own.n + 1, h), w, level, own.means)).sum()
        assert abs(total - 1) < 0.01 * own.n / (own.sums[h] + own.mu)


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    shape = M.Shape()
    keys, count = rng.integers(0, 2**63, 20_000).view(np.uint64), rng.geometric(0.1, 20_000)
    level = shape.levels(count)
    size, bits = shape.filled(keys, level)
    bloom, zero = M.LogBloom.of(shape, [size], [bits.tobytes()]), np.zeros(20_000, np.int64)
    got = bloom.highest(keys, zero)
    assert (got >= level).all() and (got == level).mean() > 0.97
    assert (bloom.highest(rng.integers(0, 2**63, 20_000).view(np.uint64), zero) > 0).mean() < 0.03
    assert shape.levels(np.array([1, 2, 3, 5, 6])).tolist() == [1, 2, 3, 4, 5]
    assert all(shape.means[q] == mean(c) for c, q in zip(range(1, 200), shape.levels(np.arange(1, 200)), strict=True))


def test_packed_numbers():
    rng = np.random.default_rng(1)
    assert all((M.unpacked(M.packed(np.array(x))) == x).all() for x in ([0, 0], [255, 0], [256], [2**62, 1]))
    x = np.sort(rng.integers(0, 2**50, 1000))
    assert (M.unpacked(M.packed(x, True), True) == x).all() and (M.unpacked(M.packed(x[::-1])) == x[::-1]).all()
    assert len(M.unpacked(M.packed(np.empty(0, np.int64)))) == 0


def test_a_hot_pair_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(M, "COUNTED", 5000)
    rows = [(i, "the same words again") for i in range(600)] + [(900, " ".join(f"v{i % 9000}" for i in range(60_000)))]
    got = {r.doc_id: r for r in M.score_documents(frame(spark, rows), bits_per_key=40, segment_bytes=50_000, max_bits=0).collect()}
    want = dict(zip([i for i, _ in rows], slow_scores(rows), strict=True))
    assert all(abs(got[i].score - s) < 1e-6 * max(1, abs(s)) for i, s in want.items()) and got[900].n_tokens == 60_001


def test_a_bigram_seen_once_counts(spark):
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(next(i for i in range(99) if i not in held), "a b c d e f g h")]
    got = {r.doc_id: r.score for r in M.score_documents(frame(spark, [*rows, (held[0], "b c d e"), (held[1], "c b e d")])).collect()}
    assert got[held[0]] > got[held[1]]


def test_empty_tables(spark):
    for way in WAYS:
        assert M.score_documents(frame(spark, []), **way).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = M.score_documents(frame(spark, [(held, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_many_words_are_neither_gathered_nor_joined_with_texts(spark, monkeypatch):
    """Each pair and word of a slice leaves it once; nothing has a row for each pair of a text."""
    monkeypatch.setattr(M, "COUNTED", 20_000)
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.5 else f"w{rng.randrange(30)}" for _ in range(200))) for i in range(600)]
    sizes, whole = [], M.kept
    monkeypatch.setattr(M, "kept", lambda df: sizes.append((whole(df), df.columns)) or sizes[-1][0])
    got = {r.doc_id: r for r in M.score_documents(frame(spark, rows), bits_per_key=40, segment_bytes=100_000, max_vocabulary=0, max_bits=0).collect()}
    want = dict(zip([i for i, _ in rows], slow_scores(rows), strict=True))
    assert len(got) == 600 and all(abs(got[i].score - s) < 1e-6 * abs(s) for i, s in want.items())
    assert max(df.count() for df, _ in sizes) < 2000  # 120,600 tokens; some 60,000 words


def test_distinct_numbers():
    rng = np.random.default_rng(2)
    for x in (np.empty(0, np.uint64), rng.integers(0, 500, 3000).astype(np.uint64), np.full(9, 7)):
        unique, back, first = M.distinct(x)
        assert unique.tolist() == np.unique(x).tolist() and (unique[back] == x).all() and (x[first] == unique).all()


def test_a_slice_takes_some_bytes_a_token():
    """A slice has a million tokens and two tasks share an executor. Here it took 59 bytes a token, of which it kept 23."""
    rng = np.random.default_rng(4)
    tokens = np.sort(np.minimum(rng.zipf(1.3, 300_000), 60_000))[rng.permutation(300_000)]
    words, codes = np.unique(tokens, return_inverse=True)
    blobs = M.packed(np.full(600, 500)), words.astype(np.uint64).tobytes(), M.packed(codes)
    tracemalloc.start()
    own = M.Slice.of(*blobs, 88)
    kept_, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (own.h[own.pair] == M.before(codes, np.arange(0, 300_001, 500), codes[-1])).all() and (own.w[own.pair] == codes).all()
    assert peak < 45 * len(codes) and kept_ < 16 * len(codes), (peak / len(codes), kept_ / len(codes))


def test_lacks_travel_as_arrays_not_as_joined_rows(spark):
    """What the words lack was joined with a row for each word of each slice, twice; that filled the executors' heaps."""
    plan = M.score_documents(frame(spark, corpus()), max_bits=0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "collect_list" not in plan
