"""SimHash near-dedup: a binary trie self-join of 64-bit fingerprints.

Fingerprints are made in one pass over the texts (XXH64 of word shingles, majority bit by bit). Equal
fingerprints are one class, so copies are never paired. The trie is dealt over the cluster by its
pigeonhole branches: of budget + 1 runs of bits, two fingerprints within the budget agree in one at
least, so every run gives each class one key, and below a key the trie is walked in node pairs. A key
with more than hot_rows classes is dealt once more by runs of the bits that are left. A task gives a
spanning forest of the links it finds, never all pairs; the forests meet in connected components.

Defined results: a null text counts as empty; texts without words have fingerprint 0, which links like
any other; texts of fewer words than a shingle are one shingle; a doc_id that stands in several rows has
one result row for each; a null doc_id never names a component unless the whole component has none.
Columns beside doc_id and text are ignored here; `similar.near_dedup`, which walks the same trie, returns them
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.components import component_labels
from vertexloom.plans.lineage import cut, partitions

SLICE = 256  # texts that are Python objects at a time
HASHES = 1 << 16  # shingle hashes whose bits are summed at a time
PAIRS = 1 << 16  # node pairs that are opened at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at 20, 09-0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, HASHES):
        block = np.fromiter(hashes, dtype=">u8", count=min(HASHES, n - start))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = batch.column(0), batch.column(1), []
            for start in range(0, batch.num_rows, SLICE):
                out += [fingerprint(t, shingle, seed) for t in texts.slice(start, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(out, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def runs(bits: int, parts: int, start: int = 0) -> list[tuple[int, int]]:
    """(first bit, width) of `parts` runs that cover bits start .. start + bits."""
    edges = [start + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _others(first: int, width: int, parts: int) -> list[tuple[int, int]]:
    """`parts` runs of the bits outside first .. first + width."""
    after = 64 - first - width
    if not first or not after:
        return runs(first or after, parts, 0 if first else width)
    before = min(max(1, round(parts * first / (first + after))), parts - 1)
    return runs(first, before) + runs(after, parts - before, first + width)


def _opened(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the child for bit 1 begins in each node values[lo:hi], all of whose values agree above `depth`."""
    bit = np.uint64(1) << (np.uint64(63) - depth.astype(np.uint64))
    first = values[lo] & ~((bit - np.uint64(1)) | bit)
    base = first | bit
    # nodes are ranges of one sorted array, group by group: a search for each over its own range
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        less = np.zeros(len(a), dtype=bool)
        less[open_] = values[mid[open_]] < base[open_]
        a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
    return a


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group: pairs of indices, each within the budget.

    values: unsigned fingerprints, sorted and distinct within each group; starts: where groups begin.
    Pairs of trie nodes are opened together. A pair is pruned when its differing bits exceed the budget
    or when what it could link is one component already.
    """
    parent = np.arange(len(values))
    firsts: list[int] = []
    seconds: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def flatten() -> None:
        while (np.take(parent, parent) != parent).any():
            parent[:] = parent[parent]

    ends = np.append(starts[1:], len(values))
    keep = ends - starts > 1
    a, b = starts[keep].astype(np.int64), ends[keep].astype(np.int64)
    zero = np.zeros(len(a), dtype=np.int64)
    stack = [(a[i : i + PAIRS], b[i : i + PAIRS], a[i : i + PAIRS], b[i : i + PAIRS], zero[i : i + PAIRS], zero[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
    while stack:
        alo, ahi, blo, bhi, depth, diff = stack.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            i, j = i[near], j[near]
            fresh = parent[i] != parent[j]
            for x, y in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    firsts.append(x)
                    seconds.append(y)
            flatten()
            rest = ~single
            alo, ahi, blo, bhi, depth, diff = (x[rest] for x in (alo, ahi, blo, bhi, depth, diff))
        if not len(alo):
            continue
        same = alo == blo
        am, bm = _opened(values, alo, ahi, depth), _opened(values, blo, bhi, depth)
        children = []
        for x0, x1, y0, y1, more, only in ((alo, am, blo, bm, 0, None), (am, ahi, bm, bhi, 0, None), (alo, am, bm, bhi, 1, None), (am, ahi, blo, bm, 1, ~same)):
            ok = (x0 < x1) & (y0 < y1) & (diff + more <= budget)
            ok &= ~((x1 - x0 == 1) & (x0 == y0))
            if only is not None:
                ok &= only
            children.append(tuple(v[ok] for v in (x0, x1, y0, y1, depth + 1, diff + more)))
        merged = [np.concatenate(x) for x in zip(*children, strict=True)]
        if len(merged[0]):
            one = (merged[1] - merged[0] == 1) & (merged[3] - merged[2] == 1) & (parent[merged[0]] == parent[merged[2]])
            merged = [x[~one] for x in merged]
        stack += [tuple(x[i : i + PAIRS] for x in merged) for i in range(0, len(merged[0]), PAIRS)]
    return np.array(firsts, np.int64), np.array(seconds, np.int64)


def _walked(budget: int):
    """mapInArrow over (key, fp), sorted within partitions: links (a, b) of each key's trie."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        values = fps.view(np.uint64)
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        i, j = trie_links(values, starts, budget)
        return pa.RecordBatch.from_arrays([pa.array(values[i].view(np.int64)), pa.array(values[j].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < 100_000:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last:
                yield links(keys[:last], fps[:last])
            parts, rows = [(keys[last:], fps[last:])], len(keys) - last
        if parts:
            yield links(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def near_links(classes: DataFrame, budget: int = 4, hot_rows: int = 20_000) -> DataFrame:
    """Links (a, b) that join all fingerprints within the budget; classes: distinct fp."""
    spark = classes.sparkSession
    blocks = runs(64, budget + 1)
    cell = lambda first, width: F.shiftrightunsigned("fp", 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
    keyed = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(n).alias("run"), (F.lit(n << 32) + cell(*b)).alias("key")) for n, b in enumerate(blocks)))).alias("x")).select("fp", "x.run", "x.key")
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.lit(True).alias("hot"))
    marked = keyed.join(hot, "key", "left")
    deeper = []
    for n, (first, width) in enumerate(blocks):
        deeper.append(F.when(F.col("run") == n, F.array(*(F.xxhash64("key", F.lit(i), cell(*b)) for i, b in enumerate(_others(first, width, budget + 1))))))
    keys = marked.select("fp", F.explode(F.when(F.col("hot"), F.coalesce(*deeper)).otherwise(F.array("key"))).alias("key"))
    return keys.select("key", "fp").repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_walked(budget), "a long, b long").distinct()


def components(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4, hot_rows: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the least doc_id reachable over links."""
    rows = cut(fingerprints(docs, shingle, seed))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(classes.select("fp"), budget, hot_rows)
    labels = component_labels(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("top"))
    owned = cut(classes.join(labels, "fp", "left").withColumn("top", F.coalesce("top", "fp")))
    least = owned.groupBy("top").agg(F.min("first").alias("component_id"))
    named = owned.join(least, "top").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
