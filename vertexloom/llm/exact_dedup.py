"""Exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is its bytes as a polynomial at fixed points modulo two primes. Two neighbours
combine as h(left) * point^len(right) + h(right), so chunks are hashed in any order and place: inside
one task for ordinary texts, and as rows of their own for huge ones. Texts of equal fingerprint and
length are then compared chunk by chunk: an aggregate of the least and the greatest chunk at each place,
combined before the shuffle, shows whether all members are the same, so that no copies meet in a task
and none are paired. If a fingerprint ever covers two texts, its group is split by the texts' SHA-256.

Defined results: null counts as empty; empty texts are one group; of rows with the same text and the same
largest doc_id all are kept; a null doc_id is kept only where its group has no other; further columns are
ignored. Texts are equal when identical after lower-casing A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import cut, partitions

PRIMES = (2147483647, 2147483629)
POINTS = (1000003, 69069)
CHUNK = 4096  # bytes hashed as one product: 4096 * 255 * 2^31 stays below 2^53
COMPARE = 1 << 16  # bytes that are compared as one row
HUGE = 8 << 20  # bytes from which a text's parts are hashed as rows of their own
SLICE = 256
_POWERS = None


def _powers() -> np.ndarray:
    """POINTS ** (CHUNK - 1 .. 0) modulo PRIMES, as exact doubles."""
    global _POWERS
    if _POWERS is None:
        table = np.empty((CHUNK, 2))
        for k, (p, x) in enumerate(zip(PRIMES, POINTS, strict=True)):
            power = 1
            for i in range(CHUNK - 1, -1, -1):
                table[i, k] = power
                power = power * x % p
        _POWERS = table
    return _POWERS


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The fingerprint of left followed by right."""
    return tuple((a * pow(x, right_length, p) + b) % p for a, b, p, x in zip(left, right, PRIMES, POINTS, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """Fingerprint of the bytes, from those of their chunks."""
    powers, whole = _powers(), len(data) // CHUNK
    found = (0, 0)
    array = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, whole, 256):
        block = array[start * CHUNK : min(whole, start + 256) * CHUNK].reshape(-1, CHUNK).astype(np.float64) @ powers
        for a, b in block.astype(np.int64).tolist():
            found = combine(found, (a % PRIMES[0], b % PRIMES[1]), CHUNK)
    if rest := len(data) - whole * CHUNK:
        a, b = (array[whole * CHUNK :].astype(np.float64) @ powers[CHUNK - rest :]).astype(np.int64).tolist()
        found = combine(found, (a % PRIMES[0], b % PRIMES[1]), rest)
    return found


def normalised(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: A-Z only


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    column = batch.column(1)
    for start in range(0, batch.num_rows, SLICE):
        for n, text in enumerate(column.slice(start, SLICE).to_pylist(), start):
            yield n, normalised(text)


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """(doc_id, f0, f1, length, text_sha256) for each row; length in bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [(*fingerprint(t), len(t), hashlib.sha256(t).hexdigest()) for _, t in _texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "f0", "f1", "length", "text_sha256"])

    slim = docs.select("doc_id", F.col("text").cast("string"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = slim.where(size < huge).mapInArrow(run, f"doc_id {kind}, f0 long, f1 long, length long, text_sha256 string")
    return small.unionByName(_huge(slim.where(size >= huge), kind, huge))


def _huge(docs: DataFrame, kind: str, part: int) -> DataFrame:
    """The same for huge texts: parts are dealt out, hashed apart and combined by length-shifted sums."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in _texts(batch):
                sha = hashlib.sha256(data).hexdigest()
                for i in range(0, len(data), part):
                    piece = data[i : i + part]
                    after = len(data) - i - len(piece)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([sha]), pa.array([len(data)]), pa.array([after]), pa.array([piece], pa.binary())], ["doc_id", "text_sha256", "length", "after", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted = [combine(fingerprint(p), (0, 0), n) for p, n in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a for a, _ in shifted], pa.int64()), pa.array([b for _, b in shifted], pa.int64())], ["doc_id", "text_sha256", "length", "f0", "f1"])

    cutup = docs.mapInArrow(parts, f"doc_id {kind}, text_sha256 string, length long, after long, piece binary")
    dealt = cutup.repartition(partitions(docs.sparkSession)).mapInArrow(hashed, f"doc_id {kind}, text_sha256 string, length long, f0 long, f1 long")
    # a repeated row doubles its parts; copies counts them again
    summed = dealt.groupBy("doc_id", "text_sha256", "length").agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), F.count("*").alias("n"))
    copies = F.expr(f"cast(n div ceil(length / {part}) as int)")
    one = summed.withColumn("copies", copies).select("doc_id", *((F.expr(f"({c} div copies) % {p}L")).alias(c) for c, p in zip(("f0", "f1"), PRIMES, strict=True)), "length", "text_sha256", F.explode(F.expr("array_repeat(0, copies)")).alias("copy"))
    return one.drop("copy")


def chunks_of(docs: DataFrame, size: int = COMPARE) -> DataFrame:
    """(f0, f1, length, place, chunk): the texts in pieces, under their own fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f0", "f1", "length", "place", "chunk"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for _, data in _texts(batch):
                a, b = fingerprint(data)
                for i in range(0, max(1, len(data)), size):
                    rows.append((a, b, len(data), i // size, data[i : i + size]))
                    held += min(size, len(data))
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "f0 long, f1 long, length long, place long, chunk binary")


def collisions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(f0, f1, length) of fingerprints that cover texts that differ; rows: fingerprints(docs)."""
    key = ["f0", "f1", "length"]
    shared = rows.groupBy(*key).count().where("count > 1").select(*key)
    members = rows.join(shared, key, "left_semi").select("doc_id").distinct()
    known = docs.join(members, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return chunks_of(known).groupBy(*key, "place").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select(*key).distinct()


def exact_groups(docs: DataFrame, fingerprinted: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text, ...)."""
    slim = docs.select("doc_id", "text")
    rows = cut(fingerprints(slim) if fingerprinted is None else fingerprinted)
    clash = cut(collisions(slim, rows))
    key = ["f0", "f1", "length"]
    if clash.isEmpty():
        rows = rows.withColumn("apart", F.lit(""))
    else:
        rows = rows.join(clash.withColumn("clash", F.lit(True)), key, "left").withColumn("apart", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
    groups = rows.groupBy(*key, "apart").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, [*key, "apart"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
