"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of words. A line goes if an earlier line (by doc_id, then text, then line
number) is the same or one word edit away: a word inserted, deleted or replaced. Lines of fewer than
min_words words go only if they are the same: an edit would be more than a fifth of them. Blank lines stay. A chain
counts link by link: a line next to an earlier one goes even if that one goes too.

Plan. Lines become 128-bit hashes; equal lines meet in an aggregate that keeps the earliest place. Two
different lines one edit apart agree in their first h or their last h words, where h follows from their
length and is half of it at most; so every line gives keys for both ends, and only lines that share a key with
another line go on (no link is lost). For these, the variants that leave out one word outside the shared end
are hashed in linear time (running XORs of positioned word hashes), and equal variants are joined: lines
with the same variant and the same gap are one replacement apart, a line that equals a variant is one
insertion away. Per variant only the earliest line is kept, by aggregates that combine before the shuffle,
so a common line never meets all others; the edit distance is then verified on the words.

Defined results: null counts as empty; words are what stands between white space, case and all else matter;
rows that repeat doc_id and text get one decision, as one document; a null doc_id comes first; a document may have any
number of lines and a line any length (only the lines that share an end with another are taken out of their document);
clashing column names do no harm, as only doc_id and text (and n_chars, which is kept true) are used.
A line or a variant that more than one in HOT rows have meets its group by a broadcast of at most HOT groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import kept

BUCKETS = 1 << 20  # bound of the broadcast that thins the second scan
COMMON = 1000  # rows up to which no group is hot
HOT = 10_000  # a group with more than one in so many rows is hot
AT = ["doc_id", "th", "line"]


def _clean(body: Column) -> Column:
    """The line's words with one space between them."""
    odd = body.startswith(" ") | body.endswith(" ")
    for mark in ("  ", "\t", "\x0b", "\f", "\r"):
        odd |= body.contains(mark)
    return F.when(odd, F.trim(F.regexp_replace(body, "[ \\t\\x0B\\f\\r]+", " "))).otherwise(body)


def _count(clean: Column) -> Column:
    return F.octet_length(clean) - F.octet_length(F.replace(clean, F.lit(" "), F.lit(""))) + 1


def _end(n: Column) -> Column:
    """h(n): half of n words, rounded down to a step that grows with n, so that most neighbouring lengths share it."""
    step = F.greatest(F.lit(1), F.pow(2, F.floor(F.log2(n)) - 4)).cast("int")
    return (F.floor(F.floor(n / 2) / step) * step).cast("int")


def _keys(n: Column) -> Column:
    """Hashes (key) of the h words at both ends (end: 0 first, 1 last) of a line of n words, for h(n) and,
    where that differs, h(n - 1): lines of n and n + 1 words both have the keys for h(n)."""
    own, less = _end(n), _end(n - 1)
    first = lambda h: F.struct(F.xxhash64(F.lit(0), h, F.call_function("substring_index", F.col("clean"), F.lit(" "), h)).alias("key"), F.lit(0).alias("end"), h.alias("h"))
    last = lambda h: F.struct(F.xxhash64(F.lit(1), h, F.call_function("substring_index", F.col("clean"), F.lit(" "), -h)).alias("key"), F.lit(1).alias("end"), h.alias("h"))
    return F.when(own == less, F.array(first(own), last(own))).otherwise(F.array(first(own), last(own), first(less), last(less)))


def _place(*columns: str) -> Column:
    return F.struct(*(F.col(c) for c in columns))


def _met(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to their group; groups: (*on, times, ...), times the number of rows. Hot groups, HOT at most, are
    broadcast, so that their rows stay where they are."""
    bar = groups.agg((F.sum("times") / HOT).alias("bar"))
    marked = groups.crossJoin(F.broadcast(bar)).withColumn("hot", F.col("times") > F.greatest("bar", F.lit(COMMON))).drop("bar")
    own = [c for c in groups.columns if c not in on]
    hot = marked.where("hot").select(*on, F.struct(*own).alias("of"))
    spread = rows.join(F.broadcast(hot), on, "left")
    apart = spread.where("of is not null").select(*rows.columns, "of.*")
    return apart.unionByName(spread.where("of is null").select(rows.columns).join(marked.where("not hot").drop("hot"), on).select(*rows.columns, *own))


def one_edit_apart(a: str, b: str) -> Column:
    """Whether two arrays of words differ by one word edit: their common ends cover all but one word."""
    ends = lambda x, y: F.expr(f"coalesce(nullif(array_position(zip_with({x}, {y}, (p, q) -> not (p <=> q)), true), 0) - 1, least(size({x}), size({y})))")
    return F.expr(f"abs(size({a}) - size({b})) <= 1") & (ends(a, b) + ends(f"reverse({a})", f"reverse({b})") >= F.expr(f"greatest(size({a}), size({b})) - 1"))


def dropped_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, th, line, near (whether by an edit) of each line that goes; th: xxhash64 of the text."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    # the generator keeps the line from being made once for every use
    worded = split.select(*AT, F.explode(F.array(_clean(F.col("body")))).alias("clean")).where("clean <> ''").withColumn("n", _count(F.col("clean")))
    keys = F.when(F.col("n") >= max(2, min_words), F.transform(_keys(F.col("n")), lambda k: k.key)).otherwise(F.array().cast("array<long>"))
    lines = kept(worded.select(*AT, F.xxhash64("clean").alias("h1"), F.xxhash64(F.lit(7), "clean").alias("h2"), keys.alias("keys")))
    owners = kept(lines.groupBy("h1", "h2").agg(F.min(_place(*AT)).alias("first"), F.count("*").alias("times")))
    again = _met(lines.select(*AT, "h1", "h2"), owners.where("times > 1"), ["h1", "h2"])
    same = again.where(_place(*AT) > F.col("first")).select(*AT, F.lit(False).alias("near"))

    ends = lines.select("h1", F.explode("keys").alias("key"))
    shared = ends.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    shared = kept(ends.join(shared, "key", "left_semi").distinct())  # (h1, key)
    some = kept(shared.select("h1").distinct().join(owners, "h1").select("h1", "h2", "first"))

    # only documents of the hash buckets that hold such lines are split again (all of them once buckets fill up)
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = some.groupBy("first.doc_id", "first.th").agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("places"))
    thin = docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(wanted.select(bucket("doc_id").alias("bucket")).distinct()), "bucket", "left_semi")
    a, b = thin.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("a"), wanted.alias("b")
    found = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    bodies = found.select("a.doc_id", "a.th", F.explode(F.array(F.split("a.text", "\n", -1))).alias("bodies"), "b.places")
    # the wanted lines are taken out before each becomes a row, which would carry the whole document along
    taken = bodies.select("doc_id", "th", F.explode(F.expr("transform(places, p -> struct(p.line as line, p.h1 as h1, p.h2 as h2, bodies[p.line] as body))")).alias("p"))
    own = taken.select(F.struct("doc_id", "th", "p.line").alias("first"), "p.h1", "p.h2", _clean(F.col("p.body")).alias("clean"))
    own = kept(own.withColumn("words", F.split("clean", " ", -1)).withColumn("n", F.size("words")).dropDuplicates(["h1", "h2"]))

    spread = own.select("h1", "h2", "n", F.posexplode("words").alias("p", "w")).select("h1", "h2", "n", "p", F.xxhash64("p", "w").alias("here"), F.xxhash64(F.col("p") - 1, "w").alias("moved"))
    line = W.Window.partitionBy("h1", "h2").orderBy("p")
    before = F.coalesce(F.bit_xor("here").over(line.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    through = F.bit_xor("moved").over(line.rowsBetween(W.Window.unboundedPreceding, 0))
    total = F.bit_xor("moved").over(W.Window.partitionBy("h1", "h2"))
    gaps = spread.select("h1", "h2", "n", "p", before.bitwiseXOR(through).bitwiseXOR(total).alias("rest"))
    # a shared end takes the variants with the gap outside it
    # a table, as the plan of the variants has it four times and is planned again after each of its stages
    known = own.select("h1", "h2", F.explode(_keys(F.col("n"))).alias("k")).select("h1", "h2", "k.key", "k.end", "k.h")
    known = kept(known.join(shared, ["h1", "key"], "left_semi"))
    ranges = known.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "end", "h")).alias("ends"))
    outside = F.filter("ends", lambda e: F.when(e.end == 0, F.col("p") >= e.h).otherwise(F.col("p") < F.col("n") - e.h))
    opened = gaps.join(ranges, ["h1", "h2"]).select("h1", "h2", "n", "p", "rest", F.explode(outside).alias("e"))
    # kind 0: same variant, same gap; kind 1: a variant (own = false) or a line that may equal one (own = true)
    variant = opened.select("h1", "h2", F.explode(F.array(F.struct(F.xxhash64("e.key", "rest", "n", "p").alias("v"), F.lit(0).alias("kind")), F.struct(F.xxhash64("e.key", "rest", F.col("n") - 1, F.lit("line")).alias("v"), F.lit(1).alias("kind")))).alias("x")).select("h1", "h2", "x.v", "x.kind")
    whole = spread.groupBy("h1", "h2", "n").agg(F.bit_xor("here").alias("z")).join(known, ["h1", "h2"]).select("h1", "h2", F.xxhash64("key", "z", "n", F.lit("line")).alias("v"), F.lit(2).alias("kind"))
    variants = variant.unionByName(whole)
    met = variants.groupBy("v").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("v")
    close = kept(variants.join(met, "v", "left_semi").join(own.select("h1", "h2", "first"), ["h1", "h2"]).select("v", "kind", "first"))

    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first")))
    earliest = close.groupBy("v").agg(least(0).alias("twin0"), least(2).alias("twin1"), least(1).alias("twin2"), F.count("*").alias("times"))
    twin = F.when(F.col("kind") == 0, F.col("twin0")).when(F.col("kind") == 1, F.col("twin1")).otherwise(F.col("twin2"))
    pairs = kept(_met(close, earliest, ["v"]).select("first", twin.alias("twin")).where(F.col("twin") < F.col("first")).distinct())
    words = own.select("first", "words")
    checked = pairs.join(words, "first").join(words.select(F.col("first").alias("twin"), F.col("words").alias("others")), "twin").where(one_edit_apart("words", "others"))
    near = checked.select("first.doc_id", "first.th", "first.line", F.lit(True).alias("near")).distinct()
    return same.unionByName(near)


def _decided(docs: DataFrame, min_words: int) -> DataFrame:
    """Per document (doc_id, th) with lines that go: gone, their numbers in order, and near, how many went by an edit."""
    gone = dropped_lines(docs, min_words)
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone"), F.countDistinct(F.when(F.col("near"), F.col("line"))).alias("near"))


def line_report(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, lines, dropped, near_dropped, dropped_lines (numbers from 0) of each row of docs."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), F.size(F.split("text", "\n", -1)).alias("lines"))
    a, b = rows.alias("a"), _decided(docs, min_words).alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left")
    gone = F.coalesce("b.gone", F.array().cast("array<int>"))
    return both.select("a.doc_id", "a.lines", F.size(gone).alias("dropped"), F.coalesce("b.near", F.lit(0)).alias("near_dropped"), gone.alias("dropped_lines"))


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """docs without the lines that go, in the same columns; documents left without a word by that go too.

    Only the documents whose hash bucket (of BUCKETS) has lines that go are shuffled; all others stay as they are.
    """
    decided = kept(_decided(docs, min_words))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    flags = F.broadcast(decided.select(bucket("doc_id").alias("bucket")).distinct().withColumn("met", F.lit(True)))
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), bucket(docs["doc_id"]).alias("bucket")).join(flags, "bucket", "left")
    a, b = held.where("met").select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("body")).alias("a"), decided.alias("b")
    both = a.join(b, F.col("a.row.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.body") == F.col("b.th")), "left").select("a.row", "b.gone", F.split("a.body", "\n", -1).alias("lines"))
    body = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    text = F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(body)
    both = both.select("row", "gone", text.alias("text")).where(F.col("gone").isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    fresh = {"text": F.col("text")} | ({"n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    cut = both.select(*(fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
    return held.where("met is null").select("row.*").unionByName(cut)


def op7_deletion_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The lines that go from each row of documents."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of lines that share a half, verified word by word.
OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM docs),
lines AS (
  SELECT doc_id, text, unnest(parts) AS body, unnest(range(len(parts))) AS line FROM split
),
worded AS (
  SELECT doc_id, text, line, list_filter(regexp_split_to_array(body, '[ \t\x0B\f\r]+'), lambda w: w <> '') AS words FROM lines
),
taken AS (SELECT *, len(words) AS n FROM worded WHERE len(words) > 0),
firsts AS (
  SELECT words, any_value(n) AS n, arg_min({'d': doc_id, 'l': line}, (doc_id, line)) AS spot FROM taken GROUP BY words
),
keys AS (
  SELECT spot, words, n, unnest([
    hash(n, 0, words[1:n // 2]), hash(n, 1, words[n // 2 + 1:]),
    hash(n - 1, 0, words[1:(n - 1) // 2]), hash(n - 1, 1, words[n - ((n - 1) - (n - 1) // 2) + 1:])]) AS key
  FROM firsts WHERE n >= 5
),
pairs AS (
  SELECT DISTINCT b.spot AS spot, b.words AS x, a.words AS y, b.n AS n, a.n AS m
  FROM keys a JOIN keys b ON a.key = b.key AND a.spot < b.spot AND abs(a.n - b.n) <= 1
),
near AS (
  SELECT DISTINCT spot FROM pairs
  WHERE len(list_filter(range(1, least(n, m) + 1), lambda i: x[1:i] = y[1:i]))
      + len(list_filter(range(1, least(n, m) + 1), lambda i: x[n - i + 1:] = y[m - i + 1:])) >= greatest(n, m) - 1
),
gone AS (
  SELECT t.doc_id, t.line, (t.doc_id, t.line) = (f.spot.d, f.spot.l) AS near
  FROM taken t JOIN firsts f ON t.words = f.words
  WHERE (t.doc_id, t.line) <> (f.spot.d, f.spot.l) OR f.spot IN (SELECT spot FROM near)
),
by_doc AS (SELECT doc_id, count(*) AS dropped, count(*) FILTER (near) AS near_dropped, list(line ORDER BY line) AS dropped_lines FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(s.parts)::INT AS lines, coalesce(g.dropped, 0)::INT AS dropped, coalesce(g.near_dropped, 0) AS near_dropped,
       list_transform(coalesce(g.dropped_lines, []), lambda i: i::INT) AS dropped_lines
FROM split s LEFT JOIN by_doc g USING (doc_id)
"""
