import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import runs as R


def slow_runs(words, exponent=3, least=24):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    letters, n = rng.choice([1, 2, 3, 5, 40]), rng.randint(0, rng.choice([20, 60, 250]))
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 6:
            a = rng.randrange(n)
            p, b = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
            for i in range(a, b):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("exponent,least", [(3, 1), (3, 3), (3, 6), (3, 10), (3, 24), (4, 12)])
def test_runs_are_those_of_brute_force(exponent, least):
    rng = random.Random(exponent * 100 + least)
    for _ in range(400):
        words = repetitive(rng)
        assert R.runs_of(np.array(words, dtype=np.int64), exponent, least) == slow_runs(words, exponent, least), words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(1, 5))
def test_powers_of_any_word(word, period, times):
    words = (word[:period] * (times * 2)) + word + word[:period] * times
    assert R.runs_of(np.array(words, dtype=np.int64), 3, 5) == slow_runs(words, 3, 5)


def test_factors_are_longest_earlier_prefixes():
    rng = random.Random(5)
    for _ in range(150):
        words = repetitive(rng)[:80]
        at = 0
        for start, size, earlier in R.factors(words):
            assert start == at
            best = max((k for k in range(1, len(words) - start + 1) if any(words[j : j + k] == words[start : start + k] for j in range(start))), default=0)
            assert size == max(best, 1) and (earlier == -1) == (best == 0)
            if best:
                assert earlier < start and words[earlier : earlier + size] == words[start : start + size]
            at += size
        assert at == len(words)


def test_no_stretch_is_lost_by_the_cut():
    rng = random.Random(9)
    for _ in range(200):
        words = repetitive(rng)
        whole = [r for s in [R._runs(np.array(words, dtype=np.int64), 3, 24)] for r in s] if words else []
        assert sorted(whole) == sorted((s, s + n) for s, n, _ in R.runs_of(np.array(words, dtype=np.int64)))


def test_long_texts_of_one_passage_take_linear_time():
    for period in (1, 7, 300):
        words = np.arange(200_000) % period
        assert R.runs_of(words) == [(0, 200_000, period)]


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        R.runs_of(np.zeros(5, dtype=np.int64), 2, 4)


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    top = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["a", "b", "é", "don't", " ", "\x1c", "😀", " x"]
    texts = [None, "", " \n\t ", "one", "a " * 30, "a b " * 12 + "c " + "a b " * 12, "  " * 24, "x y z\n" * 8 + "　 q"]
    for _ in range(400):
        words = repetitive(rng)
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\r\n", "\t "]).join(vocabulary[w % 8] if w < 8 else f"w{w}" for w in words))
    texts.append("long " * 3000 + " ".join(f"w{i}" for i in range(3000)))
    rows = [(i * 7 if i else None, t, 3) for i, t in enumerate(texts)] + [(14, "a " * 30, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((slow_row(i, t) for i, t, _ in rows), key=str)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 20
    assert R.find_runs(docs.limit(0)).count() == 0


def test_operator_gives_runs_and_texts(spark):
    docs = spark.createDataFrame([("x", "a b c " * 4 + "d"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in R.find_runs(docs, exponent=4, least=8).collect()}
    assert got["x"].runs == [(0, 12, 3)] and got["x"].collapsed == "a b c d" and got["x"].n_words == 13
    assert got[None].runs == [] and got[None].collapsed == ""
