import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vertexloom.llm import packing as P

FILE = P.vocabulary()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_file(text):
    assert P.tokenizer(FILE)(text) == Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids if len(text) > 40 else True
    assert P.tokenizer(FILE)(text) == whole().encode(text, add_special_tokens=False).ids


def whole(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizer.from_file(FILE))
    return held[0]


def test_special_token_in_a_text():
    for text in ("a<|endoftext|>b", "  <|endoftext|>", "x   \u0085 y​", "\r\n\r\n a", "١٢٣ ½ ²"):
        assert list(P.tokenizer(FILE)(text)) == whole().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("documents,cost", [(1024, 1024**2), (3, 1024**2), (1024, 300_000)])
def test_every_capacity_holds(score, documents, cost):
    rng = random.Random(7)
    lengths = np.array([rng.choice([rng.randint(1, 500), 500, 3, 512]) for _ in range(3000)])
    sequence, offset = P.pack(lengths, P.Capacity(documents=documents, cost=cost, score=score))
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.concatenate([[0], np.cumsum(lengths[own])[:-1]])).all()
        assert lengths[own].sum() <= 1024 and len(own) <= documents and (lengths[own] ** 2).sum() <= cost
    first = [np.flatnonzero(sequence == s)[0] for s in range(sequence.max() + 1)]
    assert first == sorted(first)
    if documents == 1024 and cost == 1024**2:
        assert sequence.max() + 1 <= lengths.sum() / 1024 * 1.01 + 1


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "hello", "word " * 5000, *(" ".join("abc"[: rng.randint(1, 3)] for _ in range(rng.randint(1, 900))) for _ in range(200))]
    docs = spark.createDataFrame([(i % 180 if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int").coalesce(1)
    got = P.pack_documents(docs, buffer=500).collect()
    want = []
    for i, t in enumerate(texts):
        ids = np.array(whole().encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        for n, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [first, *range(first + 1024, len(ids) + 1, 1024)], strict=True)):
            want.append((i % 180 if i else None, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack_documents(docs.limit(0)).count() == 0
