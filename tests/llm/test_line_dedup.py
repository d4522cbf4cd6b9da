import random
import re

import pytest

from vertexloom.llm import line_dedup as L


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def expected(data, least=5):
    """Every pair of lines; data without repeated doc_ids."""
    lines = []
    for doc_id, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines += [(doc_id, n, [w for w in re.split(r"[ \t\x0b\x0c\r]+", b) if w]) for n, b in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {}
    for i, (d, n, w) in enumerate(lines):
        if any(v == w for *_, v in lines[:i]):
            gone.setdefault(d, {})[n] = any(v == w for *_, v in lines[:i])
        elif len(w) >= least and any(len(v) >= least and one_edit(v, w) for *_, v in lines[:i]):
            gone.setdefault(d, {})[n] = False
    return {d: sorted(x) for d, x in gone.items()}


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 11))] for _ in range(12)]
    data = [(None, "a null id has this line"), (-3, None), (-2, ""), (-1, "\n\n"), (0, " ".join(f"x{i}" for i in range(3000)) + "\n" + " ".join(f"x{i}" for i in range(2999)))]
    for i in range(1, 60):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                kind, at = rng.randint(0, 2), rng.randrange(len(w))
                if kind == 0:
                    w[at] = rng.choice(vocab)
                elif kind == 1:
                    w.insert(at, rng.choice(vocab))
                elif len(w) > 2:
                    w.pop(at)
            out.append(rng.choice([" ", "  ", "\t"]).join(w))
        data.append((i * 7 % 61, "\n".join(out)))
    return data


def frame(spark, data):
    return spark.createDataFrame([(d, t, "k", 7, len(t or "")) for d, t in data], "doc_id long, text string, words string, line int, n_chars long")


def test_against_all_pairs(spark):
    data = corpus()
    got = L.line_report(frame(spark, data)).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.dropped_lines for r in got if r.dropped} == expected(data)


def test_texts_lose_those_lines(spark):
    data = [(1, "one two three four five\nkeep me"), (2, "one two three four six\nkeep  us\n\nkeep me"), (3, "one two three four five"), (4, None), (5, ""), (6, "short")]
    docs = frame(spark, data + [data[0]])
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(1, data[0][1], 31), (1, data[0][1], 31), (2, "keep  us\n", 9), (5, "", 0), (6, "short", 5)]
    assert out.where("doc_id = 4").count() == 1


def test_hot_lines_and_variants(spark, monkeypatch):
    data = corpus()
    data += [(1000 + i, f"the page {i} of all\nthe same line every time\nyes") for i in range(40)]
    want = expected(data)
    monkeypatch.setattr(L, "COMMON", 2)
    got = L.line_report(frame(spark, data)).collect()
    assert {r.doc_id: r.dropped_lines for r in got if r.dropped} == want


def test_a_document_of_many_lines_and_a_very_long_line(spark):
    many = "\n".join(f"line number {i % 60_000} of so many lines" for i in range(100_000))
    long = " ".join(f"x{i}" for i in range(200_000))
    got = {r.doc_id: r for r in L.line_report(frame(spark, [(1, many), (2, long), (3, "y " + long)])).collect()}
    # all of them are one word from each other
    assert got[1].lines == 100_000 and got[1].dropped_lines == list(range(1, 100_000)) and got[1].near_dropped == 59_999
    assert got[2].dropped == 0 and got[3].dropped == got[3].near_dropped == 1


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1, 2, "x"), (2, "a b c d e\nmore", 1, 2, "y")], "doc_id long, text string, row int, bucket int, gone string")
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e", 1, 2, "x"), (2, "more", 1, 2, "y")]


def test_empty_table(spark):
    docs = frame(spark, [])
    assert L.line_report(docs).count() == 0
    assert L.dedup_lines(docs).count() == 0


@pytest.mark.parametrize("a,b", [("a b c", "a c"), ("a b c", "a x c"), ("a a a", "a a"), ("a b", "b a"), ("a b c", "a b c d e"), ("a b c d", "b c d e")])
def test_one_edit_apart(spark, a, b):
    df = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>")
    assert df.select(L.one_edit_apart("a", "b")).first()[0] == one_edit(a.split(), b.split())
