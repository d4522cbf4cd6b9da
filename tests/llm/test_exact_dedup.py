import hashlib
import random

import pytest

from vertexloom.llm import exact_dedup as X


def test_fingerprints_compose():
    rng = random.Random(3)
    data = rng.randbytes(3 * X.CHUNK + 77)
    for cut in (0, 1, 77, X.CHUNK, 2 * X.CHUNK + 5, len(data)):
        assert X.combine(X.fingerprint(data[:cut]), X.fingerprint(data[cut:]), len(data) - cut) == X.fingerprint(data)
    slow = [0, 0]
    for byte in data:
        slow = [(h * x + byte) % p for h, x, p in zip(slow, X.POINTS, X.PRIMES, strict=True)]
    assert tuple(slow) == X.fingerprint(data)
    assert X.fingerprint(b"") == (0, 0)


def rows():
    rng = random.Random(1)
    texts = [None, "", "A b", "a B", "É", "é", "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y", *("copy " * 50 for _ in range(40))]
    out = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(3, "a b", "k", 1), (3, "a b", None, 1), (None, "a b", "k", 2), (None, "alone", "k", 2)]
    rng.shuffle(out)
    return out


def expected(data):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    groups = {}
    for i, t, *_ in data:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in data:
        own = groups[norm(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, length string, count int")


def test_groups_against_brute_force(spark):
    data = rows()
    assert sorted(map(tuple, X.exact_groups(frame(spark, data)).collect()), key=str) == expected(data)


def test_huge_texts_are_hashed_in_parts(spark):
    data = rows()
    docs = frame(spark, data)
    assert sorted(map(tuple, X.fingerprints(docs, huge=1000).collect()), key=str) == sorted(map(tuple, X.fingerprints(docs).collect()), key=str)


def test_a_collision_is_split(spark, monkeypatch):
    data = rows()
    docs = frame(spark, data)
    from pyspark.sql import functions as F

    poor = X.fingerprints(docs).withColumn("f0", F.lit(0).cast("long")).withColumn("f1", F.lit(0).cast("long"))
    real = X.chunks_of
    monkeypatch.setattr(X, "chunks_of", lambda d: real(d).withColumn("f0", F.lit(0).cast("long")).withColumn("f1", F.lit(0).cast("long")))
    assert sorted(map(tuple, X.exact_groups(docs, poor).collect()), key=str) == expected(data)


def test_empty_table(spark):
    assert X.exact_groups(frame(spark, [])).count() == 0
