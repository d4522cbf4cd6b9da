"""Near-dedup at a Jaccard similarity of word shingles of four fifths or more, in chains, by the SimHash trie.

Two sets of similarity 4/5 or more differ in 10 of 64 SimHash bits on average, and in 20 now and then: a trie of all
fingerprints with such a budget prunes next to nothing. So the trie's first branches are shingles here. In the order of
their hashes, two such sets share one of the first n - ceil(4n/5) + 1 shingles of each (n: its size), so below these
keys no link is lost. Every link that is used is verified on the two whole texts.

1. Below each key the trie of op10 is walked with a small budget (`sure`): it gives a spanning forest of pairs that are
   nearly always links. Where a key has no more candidates than a forest has pairs, all of them are taken. What is
   verified joins texts to components.
2. Below the keys that have more, all pairs of texts in different components are compared by their fingerprints
   (`budget`), sizes and places of the key, and then by wide fingerprints of 512 bits (`wide`), which only these texts
   get; what is left is verified. A pair comes from the least of the keys that hold more and that both texts have, once.
   A large group of near copies is one component by then, so it costs its size, not its
   square; for a group of texts that are alike but not so much, pairs of fingerprints are compared inside its task, and
   only those at a similarity of about 0.6 or more leave it.

The budgets: texts of similarity 4/5 differ in 9.7 of 64 bits with a deviation of 2.9, the shortest ones in 12 with
3.1; of 512 bits, in 78 with 8.1, and in 85 with 8.4 if they have 20 shingles (shorter ones aren't compared by them).
24 and 118 bits are about four deviations away from the worst of these, so one link in ten thousand of the worst
kind is missed, if no chain makes up for it.

Defined results: a null text counts as empty; texts without words are one group; texts of fewer words than a shingle are
one shingle; rows without a doc_id stay; repeated rows of a doc_id stay or go together; further columns are returned
untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.simhash import HASHES, SLICE, trie_links
from vertexloom.operators.components import component_labels
from vertexloom.plans.lineage import kept, partitions

BUCKETS = 1 << 20  # bound of the broadcast that thins the scan for texts
SEEN = 1 << 20  # text hashes that a task remembers
WIDE = 512  # bits
LEAST = 20  # shingles that a text needs for its wide fingerprint to count
GROUP = 64  # members of a key up to which all its pairs are counted at once
BLOCK = 50_000  # rows of keys that are walked at a time
MEMBER = "key long, th long, other long, n int, i int, fp long"


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at 20, 09-0D
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64).view(np.int64))


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), HASHES):
        ones += np.unpackbits(hashes[start : start + HASHES].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def wide_print(hashes: np.ndarray) -> bytes:
    """SimHash of a set of hashes in WIDE bits: each hash gives WIDE / 64 others."""
    ones = np.zeros(WIDE, dtype=np.int64)
    salts = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(hashes), HASHES // 8):
        x = hashes[start : start + HASHES // 8].view(np.uint64)[:, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def _signed(shingle: int):
    """mapInArrow over (doc_id, th, text): (doc_id, th, n, fp, first); first is empty where the task had the text before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                sizes, prints, first = [], [], []
                for th, text in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    own = shingles(text, shingle) if th not in seen else None
                    sizes.append(0 if own is None else len(own))
                    prints.append(0 if own is None else print_of(own))
                    # texts without words have no shingle and share the key 0
                    first.append([] if own is None else own[: len(own) - (4 * len(own) + 4) // 5 + 1] if len(own) else [0])
                    seen.add(th)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "th", "n", "fp", "first"])

    return run


def _candidates(key: np.ndarray, n: np.ndarray, i: np.ndarray, fp: np.ndarray, ends: np.ndarray, rows: np.ndarray, budget: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key that may be links, by distance in the block: rows are those to start from.

    At the first shingle that two sets share, all that they share lies there or behind it in both; they have to share
    4/9 of their sizes' sum.
    """
    at, step = rows, 1
    while len(at := at[at + step < ends[at]]):
        to = at + step
        ok = (np.minimum(n[at] - i[at], n[to] - i[to]) * 9 >= (n[at] + n[to]) * 4) & (np.bitwise_count((fp[at] ^ fp[to]).view(np.uint64)) <= budget)
        if label is not None:
            ok &= label[at] != label[to]
        yield at[ok], to[ok]
        step += 1


def _by_key(walk):
    """mapInArrow over rows sorted by key (the first column): blocks of whole keys, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        rows = 0

        def opened(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, th = columns[0], columns[1]
            order = np.lexsort((th, key))
            columns = [c[order] for c in columns]
            key, th = columns[0], columns[1]
            once = np.append(True, (key[1:] != key[:-1]) | (th[1:] != th[:-1]))  # a text may come from several tasks
            columns = [c[once] for c in columns]
            starts = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
            sizes = np.diff(np.append(starts, len(columns[0])))
            shared = np.repeat(sizes > 1, sizes)
            columns, sizes = [c[shared] for c in columns], sizes[sizes > 1]
            if len(sizes):
                yield from walk(columns, sizes)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < BLOCK:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on in the next batch
            if last:
                yield from opened([c[:last] for c in columns])
            parts, rows = [[c[last:] for c in columns]], len(columns[0]) - last
        if parts:
            yield from opened([np.concatenate(c) for c in zip(*parts, strict=True)])

    return run


def _first_walk(sure: int, budget: int):
    """Over (key, th, n, i, fp): pairs to verify (other is set), and the members of keys that hold more candidates."""

    def walk(columns: list[np.ndarray], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, th, n, i, fp = columns
        starts = np.cumsum(sizes) - sizes
        group, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(starts + sizes, sizes)
        small = np.flatnonzero(sizes[group] <= GROUP)
        found = [(a, b) for a, b in _candidates(key, n, i, fp, ends, small, budget) if len(a)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        many = np.bincount(group[a], minlength=len(sizes))
        more = (many >= sizes) | (sizes > GROUP)  # more candidates than a forest has pairs
        take = ~more[group[a]]
        pairs = [(a[take], b[take])]
        if more.any():
            own = np.flatnonzero(more[group])
            order = own[np.lexsort((fp[own].view(np.uint64), group[own]))]
            values, where = fp[order].view(np.uint64), group[order]
            new = np.append(True, (values[1:] != values[:-1]) | (where[1:] != where[:-1]))
            pairs.append((order[:-1][~new[1:]], order[1:][~new[1:]]))  # equal fingerprints follow each other
            reps = order[new]
            x, y = trie_links(values[new], np.flatnonzero(np.append(True, where[new][1:] != where[new][:-1])), sure)
            pairs.append((reps[x], reps[y]))
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(th[own]), pa.nulls(len(own), pa.int64()), pa.array(n[own]), pa.array(i[own]), pa.array(fp[own])], MEMBER_NAMES)
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if len(a):
            ends_ = np.unique(np.stack([np.minimum(th[a], th[b]), np.maximum(th[a], th[b])], axis=1), axis=0)
            none = pa.nulls(len(ends_), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ends_), pa.int64()), pa.array(ends_[:, 0]), pa.array(ends_[:, 1]), none, none, pa.nulls(len(ends_), pa.int64())], MEMBER_NAMES)

    return _by_key(walk)


MEMBER_NAMES = [x.split()[0] for x in MEMBER.split(", ")]


def _second_walk(budget: int, wide: int):
    """Over (key, th, n, i, fp, top, wide print, open keys): all candidates (a, b) in different components, each below the least
    open key that both texts have."""

    def walk(columns: list[np.ndarray], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, th, n, i, fp, top, prints, opened = columns
        broad = np.frombuffer(b"".join(prints.tolist()), np.uint64).reshape(-1, WIDE // 64)
        starts = np.cumsum(sizes) - sizes
        ends = np.repeat(starts + sizes, sizes)
        mixed = np.maximum.reduceat(top, starts) != np.minimum.reduceat(top, starts)
        rows = np.flatnonzero(np.repeat(mixed, sizes))
        held, size = [], 0
        for a, b in _candidates(key, n, i, fp, ends, rows, budget, top):
            near = (np.bitwise_count(broad[a] ^ broad[b]).sum(axis=1) <= wide) | (np.minimum(n[a], n[b]) < LEAST)
            a, b = a[near], b[near]
            once = np.array([np.intersect1d(opened[x], opened[y], assume_unique=True)[0] == key[x] for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
            a, b = a[once], b[once]
            if len(a):
                held.append(np.stack([np.minimum(th[a], th[b]), np.maximum(th[a], th[b])], axis=1))
                size += len(a)
            if size > BLOCK:
                yield _pairs(held)
                held, size = [], 0
        if held:
            yield _pairs(held)

    return _by_key(walk)


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts have similarity 4/5 or more; texts: (th, text)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, mine = [], None, None
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                for b, x, y in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if b != last:  # rows come in the order of b where a join has sorted them
                        last, mine = b, shingles(y, shingle)
                    own = shingles(x, shingle)
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    keep.append(both * 9 >= (len(own) + len(mine)) * 4)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("th").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("th").alias("b"), F.col("text").alias("y")), "b")
    return kept(both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long"))


def _thin(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, text) of the texts in the hash buckets, BUCKETS at most and broadcast, of those whose hash is wanted."""
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
    some = docs.select(F.xxhash64(_text()).alias("th"), _text().alias("text")).withColumn("bucket", bucket("th"))
    return some.join(F.broadcast(wanted.select(bucket("th").alias("bucket")).distinct()), "bucket", "left_semi").select("th", "text")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, text) of the texts whose hash is wanted; only texts in their buckets are shuffled."""
    return kept(_thin(docs, wanted).join(wanted, "th", "left_semi").dropDuplicates(["th"]))


def _broad(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(th, wide) of the texts whose hash is wanted: wide fingerprints, made where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([wide_print(shingles(t, shingle)) for t in some.column(1).to_pylist()], pa.binary())], ["th", "wide"])

    return _thin(docs, wanted).mapInArrow(run, "th long, wide binary").dropDuplicates(["th"])


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def similar_links(docs: DataFrame, rows: DataFrame, shingle: int, sure: int, budget: int, wide: int) -> DataFrame:
    """Links (a, b) between text hashes that join all texts of similarity 4/5 or more; rows: (th, n, fp, first)."""
    spark = docs.sparkSession
    dealt = lambda df: df.repartition(partitions(spark), "key").sortWithinPartitions("key")
    keys = rows.select("th", "n", "fp", F.posexplode("first").alias("i", "key")).select("key", "th", "n", "i", "fp")
    walked = kept(dealt(keys).mapInArrow(_first_walk(sure, budget), MEMBER))
    pairs = kept(walked.where("other is not null").select(F.col("th").alias("a"), F.col("other").alias("b")).distinct())
    ends = lambda p: p.select(F.col("a").alias("th")).unionByName(p.select(F.col("b").alias("th"))).distinct()
    links = _verified(_texts(docs, ends(pairs)), pairs, shingle)
    top = component_labels(links, "a", "b").select(F.col("node").alias("th"), F.col("component").alias("top"))
    members = walked.where("other is null").join(top, "th", "left").select("key", "th", "n", "i", "fp", F.coalesce("top", "th").alias("top"))
    open_ = members.groupBy("key").agg(F.min("top").alias("p"), F.max("top").alias("q")).where("p <> q").select("key")
    members = kept(members.join(open_, "key", "left_semi"))
    # a text's open keys, as many as its first shingles at most, tell below which key a pair comes first
    opened = members.groupBy("th").agg(F.sort_array(F.collect_set("key")).alias("opened"))
    members = members.join(_broad(docs, members.select("th").distinct(), shingle), "th").join(opened, "th").select(*members.columns, "wide", "opened")
    rest = kept(dealt(members).mapInArrow(_second_walk(budget, wide), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(_texts(docs, ends(rest)), rest, shingle))


def near_dedup(docs: DataFrame, shingle: int = 5, sure: int = 6, budget: int = 24, wide: int = 118) -> DataFrame:
    """The rows of docs that stay: of each component the row or rows with its least doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept(docs.select("doc_id", F.xxhash64(_text()).alias("th"), _text().alias("text")).mapInArrow(_signed(shingle), f"doc_id {kind}, th long, n int, fp long, first array<long>"))
    links = similar_links(docs, rows, shingle, sure, budget, wide)
    labels = component_labels(links, "a", "b").select(F.col("node").alias("th"), F.col("component").alias("top"))
    # texts beside all links only lose their copies
    owned = rows.groupBy("th").agg(F.min("doc_id").alias("least")).join(labels, "th", "left").select("th", "least", F.coalesce("top", "th").alias("top"))
    owned = kept(owned)
    named = owned.join(owned.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("th", "component_id")
    gone = rows.select("doc_id", "th").join(named, "th").where("doc_id <> component_id").select("doc_id").distinct()
    bucket = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    # rows outside the gone ids' hash buckets stay without a shuffle
    gone = kept(gone)
    flags = F.broadcast(gone.select(bucket().alias("__bucket")).distinct().withColumn("__met", F.lit(True)))
    return _without(docs, gone, flags, bucket)


def _without(docs: DataFrame, gone: DataFrame, flags: DataFrame, bucket) -> DataFrame:
    """docs without the rows whose doc_id is in gone; only rows whose hash bucket is flagged meet it."""
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), bucket().alias("__bucket")).join(flags, "__bucket", "left")
    apart = held.where("__met is null").select("row.*")
    met = held.where("__met").join(gone, "doc_id", "left_anti").select("row.*")
    return apart.unionByName(met)
