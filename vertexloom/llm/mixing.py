"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in a seeded random order, form blocks. Block k (from 1) of a source with weight w (of all weights
together) is released at slot floor((k - 1) / w) and due at ceil(k / w); each slot goes to the released block with the
earliest deadline. On one processor with weights that add up to 1 this meets every deadline, so at any slot a source is
less than one block from its weight for as long as it lasts. A source that runs out leaves its slots empty, and the
others keep their ratios and bounds. Weights are whole numbers in the schedule, and releases and deadlines are exact in
them. Given weights are taken as the decimals they are written as and multiplied until they are whole; where that
passes 2 ** 40, and for powers of row counts, they are multiples of the largest one's 2 ** -30 part, at least one: over
the longest schedule that moves a source by a thousandth of a block at most.

The earliest-deadline-first run is one fold in SQL over all blocks. So that it stays short whatever the data's size,
blocks hold block_rows rows or, in larger tables, the table's max_blocks-th part (rounded up); a fold of 32,768 blocks
of 20 sources takes about a second. Places within a source are counted in buckets of the random order, whose number
follows the source's size, so a source with a third of all rows is spread like the rest; rows that repeat doc_id and
source are counted first, so that they are one row until they get their places; only keys are shuffled, never texts.

Defined results: every row gets one place, repeated rows too (their order among themselves is open, they
are equal); a null source is a source of its own; a null doc_id is placed like any other; a source without a given
weight gets `default_weight`; weights must be positive; more than max_sources sources raise; texts and further columns
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import kept

BUCKETS = 4096  # of all sources together, besides one for each
UNIT = 1 << 30  # parts of the largest weight
CHUNK = 256  # steps of the fold whose picks are one array
COPIES = 65_536  # repeated rows that are given out at a time


def schedule(shares: DataFrame, max_sources: int = 4096) -> DataFrame:
    """The run: (source, share, period, nth, slot) of each block; shares: (source, share, blocks), share a positive
    whole number.

    The fold's state is the next slot and each source's next block. Of all next blocks the least by (slot from which it
    can start, deadline, source) goes next: that is the earliest deadline among those released.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", F.col("share").cast("long").alias("share"), F.col("blocks").cast("long").alias("blocks"))))
    one = shares.agg(listed.alias("all"), F.sum("share").cast("long").alias("period"), F.sum("blocks").cast("long").alias("total"))
    one = one.where("total > 0").withColumn("all", F.when(F.size("all") <= max_sources, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {max_sources} sources"))))
    heads = """
      transform(all, (a, i) -> if(st.done[i] < a.blocks, struct(
        greatest((st.done[i] * period) div a.share, st.t) as ready,
        ((st.done[i] + 1) * period + a.share - 1) div a.share as due,
        i as i), null))
    """
    step = f"""
      transform(array(array_min({heads})), p -> named_struct(
        't', p.ready + 1,
        'done', transform(st.done, (d, i) -> if(i = p.i, d + 1, d)),
        'picks', array_append(st.picks, named_struct('i', p.i, 'nth', st.done[p.i], 'slot', p.ready))))[0]
    """
    none = "cast(array() as array<struct<i:int,nth:bigint,slot:bigint>>)"
    # picks are gathered chunk by chunk, since an array is copied whenever it grows
    fold = f"""
      flatten(aggregate(sequence(0L, (total - 1) div {CHUNK}),
        named_struct('t', 0L, 'done', transform(all, a -> 0L), 'chunks', cast(array() as array<array<struct<i:int,nth:bigint,slot:bigint>>>)),
        (run, c) -> transform(array(aggregate(
            sequence(c * {CHUNK}, least(total, (c + 1) * {CHUNK}) - 1),
            named_struct('t', run.t, 'done', run.done, 'picks', {none}),
            (st, n) -> {step})), s -> named_struct('t', s.t, 'done', s.done, 'chunks', array_append(run.chunks, s.picks)))[0],
        run -> run.chunks))
    """
    picks = one.select("all", "period", F.explode(F.expr(fold)).alias("p"))
    return picks.select(F.expr("all[p.i].source").alias("source"), F.expr("all[p.i].share").alias("share"), "period", F.col("p.nth").alias("nth"), F.col("p.slot").alias("slot"))


def whole_weights(weights: list[float], most: int = 1 << 40) -> list[int]:
    """Whole numbers in the weights' ratios: exact ones if they are small enough."""
    exact = [Fraction(repr(w)) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    times = lcm(*(w.denominator for w in exact))
    if sum(exact) * times <= most:
        return [int(w * times) for w in exact]
    return [max(1, round(w / max(exact) * UNIT)) for w in exact]


def shares_of(sizes: DataFrame, weights: dict[str, float] | None, default_weight: float | None, exponent: float) -> DataFrame:
    """sizes (source, rows, ...) with share: the weight as a whole number."""
    if weights is not None:
        *own, other = whole_weights([*map(float, weights.values()), float(default_weight) if default_weight is not None else 1.0])
        given = F.create_map(*(F.lit(x) for pair in zip(weights, own, strict=True) for x in pair)) if weights else None
        share = F.try_element_at(given, F.coalesce("source", F.lit(""))) if weights else F.lit(None)
        return sizes.withColumn("share", F.coalesce(share.cast("long"), F.lit(other).cast("long")))
    weighed = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(float(exponent))))
    most = weighed.agg(F.max("weight").alias("most"))
    return weighed.crossJoin(F.broadcast(most)).withColumn("share", F.greatest(F.lit(1), F.round(F.col("weight") / F.col("most") * UNIT)).cast("long")).drop("weight", "most")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float | None = None,
    exponent: float = 0.5,
    block_rows: int = 16,
    max_blocks: int = 32_768,
    seed: int = 42,
    max_sources: int = 4096,
) -> DataFrame:
    """A place for each row of docs (doc_id, source, ...): order by slot, place for the mixture.

    Returns doc_id, source, block (from 1), place (in the block, from 0), released, due (slots), slot.
    Without weights a source weighs rows ** exponent. What is broadcast is bounded: a row for each source, at most
    max_blocks + max_sources blocks and BUCKETS + max_sources buckets.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.groupBy("doc_id", "source").agg(F.count("*").alias("times")).withColumn("digest", digest)
    rows = rows.select("doc_id", "source", "times", _hex(F.col("digest"), 1, 8).alias("upper"), _hex(F.col("digest"), 9, 15).alias("lower"))
    total = docs.agg(F.count("*").alias("total"), F.greatest(F.lit(block_rows), F.ceil(F.count("*") / max_blocks)).cast("long").alias("size"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(total))
    sizes = sizes.withColumn("blocks", F.expr("(rows + size - 1) div size")).withColumn("cells", F.ceil(F.col("rows") * BUCKETS / F.col("total")).cast("long"))
    # sizes, the run and the offsets are bounded, and the plans below hold their tables instead of how they are made,
    # which would be planned again after every stage in the driver's memory
    sizes = kept(sizes)
    picks = kept(schedule(shares_of(sizes, weights, default_weight, exponent), max_sources))
    # the random order's upper 32 bits choose the bucket: buckets are even and in order
    of = sizes.select(F.col("source").alias("s"), "cells", "size")
    dealt = rows.join(F.broadcast(of), _same(F.col("source"), F.col("s"))).withColumn("bucket", F.shiftrightunsigned(F.col("upper") * F.col("cells"), 32)).drop("s", "cells")
    here = W.Window.partitionBy("source", "bucket").orderBy("upper", "lower", "doc_id").rowsBetween(W.Window.unboundedPreceding, -1)
    within = dealt.withColumn("n", F.coalesce(F.sum("times").over(here), F.lit(0)))
    counts = dealt.groupBy("source", "bucket").agg(F.sum("times").alias("rows"))
    before = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = kept(counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    numbered = within.join(F.broadcast(offsets), _same(F.col("source"), F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("n", F.col("n") + F.col("offset")).drop("s")
    # repeated rows take the places from n on
    numbered = numbered.withColumn("part", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES})")))
    numbered = numbered.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(times, (part + 1) * {COPIES}) - 1)"))).withColumn("n", F.col("n") + F.col("copy"))
    blocks = numbered.select("doc_id", "source", F.expr("n div size").alias("k"), F.expr("cast(n % size as int)").alias("place"))
    run = picks.select(F.col("source").alias("s"), "share", "period", "nth", "slot")
    found = blocks.join(F.broadcast(run), _same(F.col("source"), F.col("s")) & (F.col("k") == F.col("nth")))
    return found.select(
        "doc_id", "source", (F.col("k") + 1).alias("block"), "place",
        F.expr("(k * period) div share").alias("released"),
        F.expr("((k + 1) * period + share - 1) div share").alias("due"),
        "slot",
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in the order of the mixture, range-partitioned by slot; every row once.

    Rows join their places by doc_id and source; rows that repeat both take the first one's place (`mix` gives each of
    them a place of its own). Further columns keep their names and values, whatever the names are.
    """
    places = mix(docs, **options).groupBy("doc_id", "source").agg(F.min(F.struct("slot", "place")).alias("at"))
    a = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("source")).alias("a")
    both = a.join(places.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    return both.select("a.row", "b.at").sort("at").select("row.*")


def op6_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's block, release, deadline and slot; sources weigh by the square root of their rows."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same run as a recursive query, one step for each block.
OP6_SQL = """
WITH RECURSIVE total AS (SELECT count(*) AS total, greatest(16, ceil(count(*) / 32768))::BIGINT AS size FROM documents),
sizes AS (SELECT source, count(*) AS nrows FROM documents GROUP BY source),
shares AS (
  SELECT source, (nrows + size - 1) // size AS blocks,
         greatest(1, round(sqrt(nrows) / max(sqrt(nrows)) OVER () * 1073741824))::BIGINT AS share,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sizes, total
),
lists AS (SELECT list(share ORDER BY i) AS sh, list(blocks ORDER BY i) AS bl, sum(share)::BIGINT AS period, sum(blocks)::BIGINT AS steps FROM shares),
run AS (
  SELECT 0::BIGINT AS step, 0::BIGINT AS t, list_transform(sh, lambda x: 0::BIGINT) AS done, 0::BIGINT AS i, 0::BIGINT AS nth, 0::BIGINT AS slot FROM lists
  UNION ALL
  SELECT step + 1, h.ready + 1, list_transform(range(1, len(done) + 1), lambda k: done[k] + (k = h.i)::BIGINT), h.i, done[h.i], h.ready
  FROM (
    SELECT step, done, list_min(list_transform(list_filter(range(1, len(done) + 1), lambda k: done[k] < bl[k]), lambda k: {
      'ready': greatest(done[k] * period // sh[k], t), 'due': ((done[k] + 1) * period + sh[k] - 1) // sh[k], 'i': k})) AS h
    FROM run, lists WHERE step < steps
  )
),
numbered AS (
  SELECT d.doc_id, d.source, row_number() OVER (
    PARTITION BY d.source ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, ''))[1:23], d.doc_id) - 1 AS n
  FROM documents d
),
blocks AS (SELECT doc_id, source, n // size AS k, (n % size)::INT AS place FROM numbered, total)
SELECT b.doc_id, b.source, b.k + 1 AS block, b.place, b.k * period // s.share AS released,
       ((b.k + 1) * period + s.share - 1) // s.share AS due, r.slot
FROM blocks b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source JOIN run r ON r.step > 0 AND r.i = s.i AND r.nth = b.k, lists
"""
