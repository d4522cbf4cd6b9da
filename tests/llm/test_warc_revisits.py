import random

import pytest
from pyspark.sql import functions as F

from vertexloom.llm import warc_revisits as R

SCHEMA = "record_id long, url string, time long, type string, status int, headers map<string,string>, digest string, length long, canonical string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#f", "example.com/a?a=1&b=2"),
        ("https://m.example.com", "example.com"),
        ("http://example.com/?ref=x", "example.com"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u"))).first()[0]


def rows():
    rng = random.Random(2)
    out = []
    for i in range(600):
        url = f"http{'s' * (i % 2)}://{'hot' if i % 3 else rng.choice('abc')}.org/{'' if i % 5 else '#x'}"
        tag = rng.choice(['"1"', 'W/"1"', '"2"', None])
        seen = rng.choice(["mon", "tue", None])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", seen), ("Content-Type", f"t{i}"), ("X", f"{i}"), ("Connection", "close")) if v}
        kind = rng.choice([("response", 200), ("revisit", 304), ("revisit", 304), ("response", 404), ("request", 0)])
        out.append((i, url, rng.randrange(200), *kind, headers, f"d{i}", i))
    out += [(900, None, 5, "revisit", 304, {}, None, 0), (901, "http://hot.org", None, "revisit", 304, None, None, 0), (902, "http://a.org", 500, "revisit", 304, None, None, 0)]
    return out + [out[1], out[2]]


def expected(data):
    canon = {u: None if u is None else u.split("#")[0].split("//")[1].rstrip("/") for _, u, *_ in data}
    out = []
    for i, u, t, kind, _, headers, *_ in data:
        if kind != "revisit":
            continue
        past = [r for r in data if r[3:5] == ("response", 200) and u is not None and t is not None and canon[r[1]] == canon[u] and r[2] < t]
        own = {k.lower(): v for k, v in (headers or {}).items()}
        if not past:
            out.append((i, canon[u], t, None, "missing", None, None, None))
            continue
        was = max(past, key=lambda r: (r[2], r[0]))
        old = {k.lower(): v for k, v in was[5].items()}
        if "etag" in own and "etag" in old:
            same = own["etag"].removeprefix("W/") == old["etag"].removeprefix("W/")
        elif "last-modified" in own and "last-modified" in old:
            same = own["last-modified"] == old["last-modified"]
        else:
            same = None
        merged = {k: v for k, v in old.items() if k not in R.HOP_BY_HOP} | {k: v for k, v in own.items() if k not in R.HOP_BY_HOP + R.KEPT}
        status = {None: "unchecked", True: "resolved", False: "changed"}[same]
        out.append((i, canon[u], t, was[0], status, *((sorted(merged.items()), was[6], was[7]) if same is not False else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [50_000, 20])
def test_against_brute_force(spark, cell_rows):
    data = rows()
    got = [(*r[:5], sorted(r.headers.items()) if r.headers is not None else None, *r[6:]) for r in R.resolve(frame(spark, data), cell_rows).collect()]
    assert sorted(got, key=str) == expected(data)


def test_bodies_and_empty_table(spark):
    data = [(1, "http://a/b", 1, "response", 200, {"ETag": "x"}, "d", 3), (2, "http://a/b", 2, "revisit", 304, {"etag": "x"}, None, 0), (3, "http://a/b", 0, "revisit", 304, {"etag": "x"}, None, 0)]
    bodies = spark.createDataFrame([(1, "text"), (1, "text")], "record_id long, body string")
    assert sorted((r.record_id, r.body) for r in R.with_bodies(R.resolve(frame(spark, data)), bodies).collect()) == [(2, "text"), (3, None)]
    assert R.resolve(frame(spark, [])).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "http://a", "x")], "page_id long, url string, html string")
    assert R.resolve(R.records_of_pages(pages)).count() == 2
