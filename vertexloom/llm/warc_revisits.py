"""Not-modified revisit resolution of WARC records.

A revisit record (HTTP 304, no body) stands for the latest earlier full response of its canonical URL. The
as-of join takes, for each revisit, the response with the greatest (time, record id) before its own. Then
validators are checked: where both sides have an ETag they must agree by weak comparison, else where both
have Last-Modified these must agree; a revisit with neither is resolved as unchecked. A resolved revisit
gets the response's headers updated by its own, but for those that a 304 must not change (fields of the body
and its framing, and hop-by-hop fields).

Plan: responses and revisits of a URL are put in order over time cells. A cell is a slice of a URL's time
range; URLs with few records have one cell, and a URL's cells grow in number with its records, so that a URL
with a third of all records is spread out. Within cells a window carries the last response forward; the
cells' last responses, one row each, are carried forward by a second, small window; one join brings them
back. Bodies are not shuffled: records keep a digest and a length, and `with_bodies` joins texts by record id
when they are wanted.

Defined results: a revisit without an earlier response has status "missing"; with validators that contradict,
"changed"; ties in time go to the greater record id; repeated response rows count once; repeated revisit rows
stay; a null URL or time is never matched (status "missing"); null headers are no headers; clashing column
names do no harm, as only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import cut

#: Header fields that a 304 must not change in a stored response (fixed values).
KEPT = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding")
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade")
#: Query fields that only track the visitor (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """One form for a page's URLs: no scheme, no leading www. or m., lower-case host without a default port, no
    fragment, no trailing slash, query fields in order and without those that track."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda f: (f != "") & ~F.substring_index(f, "=", 1).isin(*TRACKING))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lowered(headers: Column) -> Column:
    """Headers with lower-case names; of names that clash the last in order stays."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p.key))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p.key == n), -1).value)))


def merged(stored: Column, fresh: Column) -> Column:
    """Headers of the stored response as the revisit's permitted ones update them."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT, *HOP_BY_HOP))
    old = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k) & ~k.isin(*HOP_BY_HOP))
    return F.map_concat(old, allowed)


def resolve(records: DataFrame, cell_rows: int = 50_000) -> DataFrame:
    """One row for each revisit of records (record_id, url, time, type, status, headers, digest, length).

    type is response or revisit; full responses are those of type response with status 200. Returns
    record_id, canonical, time, refers_to, status (resolved, unchecked, changed, missing), headers, digest, length.
    """
    full = (F.col("type") == "response") & (F.col("code") == 200)
    slim = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("time").cast("long").alias("time"), "type", F.col("status").alias("code"), lowered(F.col("headers")).alias("headers"), "digest", "length")
    slim = slim.select("*", full.alias("full"), (F.col("type") == "revisit").alias("revisit")).where("full or revisit")
    known = slim.where("canonical is not null and time is not null and record_id is not null")
    spans = known.groupBy("canonical").agg(F.count("*").alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi")).where(F.col("n") > cell_rows)
    width = F.greatest(F.lit(1), F.expr(f"(hi - lo) div ceil(n / {cell_rows}) + 1"))
    celled = known.join(spans.select("canonical", "lo", width.alias("width")), "canonical", "left").withColumn("cell", F.coalesce(F.expr("(time - lo) div width"), F.lit(0).cast("long"))).drop("lo", "width")
    celled = cut(celled)

    held = F.when(F.col("full"), F.struct("time", "record_id", "headers", "digest", "length"))
    past = W.Window.partitionBy("canonical", "cell").orderBy("time", "full", "record_id")
    # at one time a revisit comes before a response, so its own window ends with what is earlier
    inside = celled.withColumn("near", F.last(held, ignorenulls=True).over(past.rowsBetween(W.Window.unboundedPreceding, -1)))
    cells = celled.where("full").groupBy("canonical", "cell").agg(F.max_by(F.struct("time", "record_id", "headers", "digest", "length"), F.struct("time", "record_id")).alias("tail"))
    waiting = inside.where("revisit and near is null").select("canonical", "cell").distinct()
    marks = cells.join(waiting, ["canonical", "cell"], "full_outer")
    far = marks.withColumn("far", F.last("tail", ignorenulls=True).over(W.Window.partitionBy("canonical").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1))).select("canonical", "cell", "far")
    found = inside.where("revisit").join(far, ["canonical", "cell"], "left").withColumn("was", F.coalesce("near", "far")).drop("near", "far", "cell")
    lost = slim.where("revisit and (canonical is null or time is null or record_id is null)").withColumn("was", F.lit(None).cast(found.schema["was"].dataType))
    return _judged(found.unionByName(lost.select(found.columns)))


def _judged(found: DataFrame) -> DataFrame:
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    e1, e2 = F.try_element_at("headers", F.lit("etag")), F.try_element_at("was.headers", F.lit("etag"))
    m1, m2 = F.try_element_at("headers", F.lit("last-modified")), F.try_element_at("was.headers", F.lit("last-modified"))
    agrees = F.when(e1.isNotNull() & e2.isNotNull(), weak(e1) == weak(e2)).when(m1.isNotNull() & m2.isNotNull(), m1 == m2)
    status = F.when(F.col("was").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    ok = F.col("verdict").isin("resolved", "unchecked")
    judged = found.withColumn("verdict", status)
    return judged.select(
        "record_id", "canonical", "time", F.col("was.record_id").alias("refers_to"), F.col("verdict").alias("status"),
        F.when(ok, merged(F.col("was.headers"), F.col("headers"))).alias("headers"), F.when(ok, F.col("was.digest")).alias("digest"), F.when(ok, F.col("was.length")).alias("length"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """resolved with the body of the response it refers to; bodies: (record_id, body)."""
    wanted = F.when(F.col("status").isin("resolved", "unchecked"), F.col("refers_to"))
    own = bodies.select(F.col("record_id").alias("__id"), "body").dropDuplicates(["__id"])
    return resolved.join(own, wanted == F.col("__id"), "left").drop("__id")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl's records from pages (page_id, url, html): a full response for each page, at a time that follows
    from its id, and a revisit by the plain https URL some time later, before or after others' responses.

    Numbers of revisits whose page has changed meanwhile (another ETag) follow from the id's hash.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body), 1, 16), F.lit('"'))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), tag.alias("tag"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("length"))
    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("length").cast("string"), F.lit("ETag"), F.col("tag"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Connection"), F.lit("close")).alias("headers"),
        "digest", "length",
    )
    fresh = F.when(F.col("page_id") % 7 == 3, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    later = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", "^http:", "https:").alias("url"), (F.col("page_id") * 10 + 5 + F.col("page_id") % 1000 * 100).alias("time"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), fresh, F.lit("cache-control"), F.lit("max-age=300"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("length"),
    )
    return first.unionByName(later)


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """What each revisit record made from pages stands for; headers as sorted name: value lines."""
    out = resolve(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e.key, e.value))), "\n")
    return out.withColumn("headers", lines)


OP1_SQL = r"""
WITH base AS (
  SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, sha256(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS length FROM pages
),
parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM base
),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid'], string_split(f, '=')[1]))) AS fields
  FROM parts
),
named AS (
  SELECT *, page || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS canonical FROM canon
),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, page_id * 10 + 5 + page_id % 1000 * 100 AS time, CASE WHEN page_id % 7 = 3 THEN '"other"' ELSE tag END AS tag FROM named
),
matched AS (
  SELECT r.record_id, r.canonical, r.time, r.tag, arg_max(struct_pack(id := n.page_id * 2, tag := n.tag, digest := n.digest, length := n.length), (n.page_id * 10, n.page_id * 2)) AS was
  FROM revisits r LEFT JOIN named n ON n.canonical = r.canonical AND n.page_id * 10 < r.time GROUP BY ALL
)
SELECT record_id, canonical, time, was.id AS refers_to, CASE WHEN was.tag = tag THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN was.tag = tag THEN 'cache-control: max-age=300' || chr(10) || 'content-length: ' || was.length || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || tag END AS headers,
  CASE WHEN was.tag = tag THEN was.digest END AS digest, CASE WHEN was.tag = tag THEN was.length END AS length
FROM matched
"""
