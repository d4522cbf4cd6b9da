import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vertexloom.llm import fill_in_middle as M

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def slow_row(doc_id, text):
    text = text or ""
    groups = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(groups[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab <>PSM\n é😀"), st.integers(0, 400))
def test_round_trip(text, doc_id):
    n, form, prefix, middle, output = M.transform(str(doc_id), text, 100, 50, 7, M.MARKERS)
    assert M.original(output, form, M.MARKERS) == text
    assert n == len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text))
    assert M.ends_of_units(text)[-1] == len(text)


def test_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", "  \n", "one", "a <P> b", "<S", "<<S>", "x y   z", "word " * 40_000]
    texts += ["".join(rng.choice("ab  \n\t<PSM>é😀") for _ in range(rng.randint(1, 200))) for _ in range(600)]
    rows = [(i if i else None, t, "k") for i, t in enumerate(texts)] + [(5, texts[5], "k")]
    spark.createDataFrame(rows, "doc_id long, text string, output string").write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13_fill_in_middle(spark, str(tmp_path))
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=str) == sorted((slow_row(i, t) for i, t, _ in rows), key=str)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"]


def test_operator_gives_texts(spark):
    docs = spark.createDataFrame([(str(i), f"alpha beta gamma {i}") for i in range(100)], "doc_id string, text string")
    made = M.fill_in_middle(docs, percent=100, spm_percent=0, markers=("[[p]]", "[[s]]", "[[m]]"))
    back = M.restore(made, markers=("[[p]]", "[[s]]", "[[m]]")).collect()
    assert {r.doc_id: r.text for r in back} == {str(i): f"alpha beta gamma {i}" for i in range(100)}
    assert all(r.form == "psm" and r.output.startswith("[[p]]") and r.output_sha256 == sha(r.output) for r in back)
    assert M.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("markers", [("<P>", "<S>", "<P>"), ("a", "aa", "b"), ("aba", "c", "d"), ("", "b", "c"), ("ab", "bc", "x")])
def test_markers_that_could_be_mistaken_are_refused(markers):
    with pytest.raises(ValueError, match="three markers"):
        M._checked(markers)


def test_outputs_without_markers_are_refused():
    for output, form in (("x", "psm"), ("<P>a<M>b", "psm"), ("<P>a<S>b<M>c", "spm"), ("x", "other")):
        with pytest.raises(ValueError):
            M.original(output, form, M.MARKERS)
