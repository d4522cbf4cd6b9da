import random

import numpy as np
import pytest
import xxhash

from vertexloom.llm import simhash as S


def slow_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, budget=4):
    top = {v: v for v in values}

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "a b c", "A b\x0bC d E", "É à b c d e", "x " * 70_000, "a b c d e"])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_trie_links_all_groups():
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centres for _ in range(30)}
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 7, 2**64 - 1}
    array = np.array(sorted(values), dtype=np.uint64)
    i, j = S.trie_links(array, np.array([0]))
    assert (np.bitwise_count(array[i] ^ array[j]) <= 4).all()
    top = {int(v): int(v) for v in array}
    find = lambda v: v if top[v] == v else find(top[v])
    for a, b in zip(array[i].tolist(), array[j].tolist(), strict=True):
        p, q = sorted((find(a), find(b)))
        assert p != q  # a forest
        top[q] = p
    assert {v: find(v) for v in top} == classes(values)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, count int")


@pytest.mark.parametrize("hot", [20_000, 1])
def test_components_against_brute_force(spark, hot):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(15)]
    rows = [(1000, None, "k", 1), (3, "", None, 2), (4, "a b", "k", 3), (4, "a b", "k", 3), (None, "a b", "k", 3)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((10 + i, " ".join(w), "k", 0))
    got = S.components(frame(spark, rows), hot_rows=hot).collect()
    prints = [(d, slow_fingerprint(t)) for d, t, *_ in rows]
    top = classes({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[top[p]] = min(d, least.get(top[p], d))
    want = sorted(((d, f"{p:016x}", least[top[p]]) for d, p in prints), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    assert S.components(frame(spark, [])).count() == 0
