import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import byte_bpe as B

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.vocabulary(), "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(text):
    codec = B.codec()
    ids, starts, ends = codec.encode(text)
    assert ids.tolist() == THEIRS.encode_ordinary(text)
    assert codec.decode(ids.tolist()) == text.encode()
    assert "".join(codec.texts_of_tokens(ids.tolist())) == text
    at, data = 0, text.encode()
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        token = codec.bytes_of[i]
        assert token in text[a:b].encode()
        first, last = len(text[:a].encode()), len(text[:b].encode())
        assert first <= at and at + len(token) <= last and data[at : at + len(token)] == token
        assert len(text[: a + 1].encode()) > at and len(text[: b - 1].encode()) < at + len(token)  # no wider than needed
        at += len(token)
    assert at == len(data)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aab's \n\t é-=1٣😀ß́　가 <|endoftext|>"))
def test_texts_of_few_characters(text):
    check(text)


def test_every_twentieth_character_and_new_letters():
    new = [ord(c) for name in (r"\p{L}", r"\p{N}") for part in B._differences(name) for c in part[::50]]
    for code in [*range(0, 0xD800, 20), *range(0xE000, 0x110000, 400), *new]:
        check(f"a{chr(code)}a 1{chr(code)}1 !{chr(code)}! {chr(code)} x {chr(code) * 2}  x")


def test_pairs_of_equal_rank_side_by_side():
    tried = 0
    for token in RANKS:
        for i in range(1, len(token)):
            left, middle = token[:i], token[i:]
            right = token[len(middle) :]
            if left in RANKS and middle in RANKS and right in RANKS and token.startswith(middle):
                tried += 1
                try:
                    check((left + middle + right).decode())
                except UnicodeDecodeError:
                    continue
    assert tried > 100


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "MEMO", 10)
    codec = B.Codec(B.vocabulary(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(30)) + " " + "z" * 100
        assert codec.encode(text)[0].tolist() == THEIRS.encode_ordinary(text)
        assert len(codec.memo) <= 10


def test_split_characters_of_pieces():
    codec = B.codec()
    ids = codec.encode("x 😀\U0001f9ff y")[0].tolist()
    for cut in range(len(ids) + 1):
        assert codec.decode(ids[:cut]) + codec.decode(ids[cut:]) == "x 😀\U0001f9ff y".encode()
    assert any("" == t for t in codec.texts_of_tokens(ids))
    with pytest.raises(KeyError):
        codec.decode([10**6])


def test_query_and_columns(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "Grüße, Jürgen!  \n\n ok", "naïve 😀" * 3000, "z" * 50_000]
    texts += ["".join(rng.choice("ab é'\n s1😀가") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = B.op12_byte_bpe(spark, str(tmp_path))

    def row(doc_id, text):
        ids = THEIRS.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got.collect()), key=str) == sorted((row(i, t) for i, t, _ in rows), key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    back = B.encode(docs).select(B.decoded_text("ids").alias("text"), B.texts_of_tokens("ids").alias("parts")).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows) and all("".join(r.parts) == r.text for r in back)
    assert B.encode(docs.limit(0)).count() == 0
    halves = spark.sql("select cast(null as array<int>) ids").unionAll(spark.createDataFrame([(THEIRS.encode_ordinary("😀")[:1],)], "ids array<int>"))
    assert [r[0] for r in halves.select(B.decoded_text("ids")).collect()] == [None, "�"]


def test_query_has_one_python_worker_a_task(spark, tmp_path):
    texts = [None, "", "naïve 😀", "z" * 5000, *(f"text {i}" for i in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = B.op12_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    both = B.encode(docs, back=True).select("doc_id", "bytes", B.decoded("ids").alias("again")).collect()
    assert {r.doc_id: bytes(r.bytes) for r in both} == {r.doc_id: bytes(r.again) for r in both} == {i: (t or "").encode() for i, t in enumerate(texts)}
