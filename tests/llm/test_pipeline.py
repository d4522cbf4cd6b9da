import random

import numpy as np
from test_line_dedup import expected as gone_lines
from test_packing import whole
from test_similar import expected as kept_ids

import corpus_pipeline
from vertexloom.llm import toxicity as T


def corpus():
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lo", "mi", "tan", "res", "nu")]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 40)))
    shared = [line() for _ in range(6)]
    rows, labels = [], []
    for i in range(260):
        parts = [line() for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        if i % 5 == 0:
            parts[0] = f"{parts[0]} you idiot"
        rows.append((i, "\n".join(parts), "en", "hot" if i % 3 else f"s{i % 7}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    long = [rng.choice(vocab) for _ in range(1500)]
    rows.append((300, " ".join(long), "en", "hot", 0))
    for i in (301, 302):
        other = list(long)
        other[i * 3], other[i], other[i + 9] = "xx", "yy", "zz"
        rows.append((i, " ".join(other), "en", "s1", 0))
    rows += [(400, rows[7][1], "en", "s2", 0), (401, None, None, None, None), (402, "", "en", "s3", 0), (403, "short", "en", None, 5)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    grammar = T.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    stay = [r for r in rows if grammar.score(r[1]) < 0.5]
    assert 40 <= len(rows) - len(stay) <= 60
    gone = gone_lines(stay)
    cut = []
    for i, t, *_ in stay:
        if i in gone:
            left = [b for n, b in enumerate(t.split("\n")) if n not in gone[i]]
            if not "".join(left).strip():
                continue
            t = "\n".join(left)
        cut.append((i, t))
    stays = set(kept_ids(cut)[0])
    want = {}
    for i, t in cut:
        if i in stays:
            want[i] = len(whole().encode(t or "", add_special_tokens=False).ids) + 1
    assert 300 in want and 301 not in want and 400 not in want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, held = {}, {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 1024


def test_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
