"""Vector best-fit packing of tokenised documents into training sequences.

Documents longer than a sequence are cut into full pieces, the first of which may be shorter. Each
piece has a demand on three capacities of a sequence: tokens, documents, and attention cost (the sum of
squared piece lengths, as attention stays within a document). Pieces are taken from long to short, and
each goes to the open sequence that fits under every capacity and scores best: the least weighted norm of
what would be left, or the greatest weighted dot product of demand and residual.

A task packs the pieces of its own input split, in buffers of `buffer` pieces, so nothing is shuffled and
a hot source or copied text has no effect; a split leaves a few sequences unfilled at most. Memory holds a
slice of texts and the buffer's lengths. Sequences follow the order of their first pieces in the input, so
an input that is ordered as a mixture gives sequences in that order.

Defined results: null counts as empty; an empty text is one piece of the end token alone; repeated rows are
packed each; a null doc_id is carried as it is; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 128
#: How byte-level tokenizers of this family cut a text (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; weights are those of the score's three parts."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"  # or "dot"


class _Open:
    """Open sequences as columns: residual tokens, documents and cost."""

    def __init__(self, capacity: Capacity):
        self.whole = np.array([capacity.tokens, capacity.documents, capacity.cost], dtype=np.float64)
        self.weights = np.array(capacity.weights)
        self.dot = capacity.score == "dot"
        self.left = np.empty((3, 64))
        self.ids = np.empty(64, dtype=np.int64)
        self.n = 0

    def best(self, demand: np.ndarray) -> int:
        """Index of the best sequence that fits, or -1; ties go to the one opened first."""
        left = self.left[:, : self.n]
        fits = np.flatnonzero((left[0] >= demand[0]) & (left[1] >= demand[1]) & (left[2] >= demand[2]))
        if not len(fits):
            return -1
        share = left[:, fits] / self.whole[:, None]
        need = (demand / self.whole)[:, None]
        score = -(self.weights[:, None] * share * need).sum(axis=0) if self.dot else (self.weights[:, None] * (share - need) ** 2).sum(axis=0)
        return int(fits[np.argmin(score)])

    def add(self, number: int, demand: np.ndarray) -> None:
        if self.n == len(self.ids):
            self.left, self.ids = np.concatenate([self.left, np.empty_like(self.left)], axis=1), np.concatenate([self.ids, np.empty_like(self.ids)])
        self.left[:, self.n], self.ids[self.n] = self.whole - demand, number
        self.n += 1

    def put(self, at: int, demand: np.ndarray) -> int:
        """Take demand from sequence `at`; a full one is closed."""
        self.left[:, at] -= demand
        number = int(self.ids[at])
        if self.left[:, at].min() < 1:
            self.left[:, at : self.n - 1], self.ids[at : self.n - 1] = self.left[:, at + 1 : self.n].copy(), self.ids[at + 1 : self.n].copy()
            self.n -= 1
        return number


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0 by their first piece's place."""
    n = len(lengths)
    sequence, offset = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n and (lengths.max() > capacity.tokens or float(lengths.max()) ** 2 > capacity.cost or capacity.documents < 1):
        raise ValueError("a piece exceeds a capacity of an empty sequence")
    # a piece that fills a sequence needs no search
    full = lengths == capacity.tokens
    sequence[full] = np.arange(int(full.sum()))
    count = int(full.sum())
    bins, used = _Open(capacity), {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        if full[i]:
            continue
        size = int(lengths[i])
        demand = np.array([size, 1, size * size], dtype=np.float64)
        at = bins.best(demand)
        if at < 0:
            bins.add(count, demand)
            number, count = count, count + 1
        else:
            number = bins.put(at, demand)
        sequence[i], offset[i] = number, used.get(number, 0)
        used[number] = int(offset[i]) + size
    first = np.full(count, n, dtype=np.int64)
    np.minimum.at(first, sequence, np.arange(n))
    rank = np.empty(count, dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(count)
    return rank[sequence] if n else sequence, offset


def _bytes_of_characters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the others for the
    characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def tokenizer(path: str):
    """Ids of a text by the byte-level tokenizer in the file.

    Where a text holds none of the file's added tokens, its vocabulary is run by tiktoken, which gives the same ids
    five times as fast if ids are in the order of merges (else, and for other texts, the tokenizer itself encodes).
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    model = json.loads(whole.to_str())["model"]
    added = {t.content for t in whole.get_added_tokens_decoder().values()}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return slow
    of = _bytes_of_characters()
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if any(t in text for t in added) else fast.encode_ordinary(text)


def vocabulary() -> str:
    """Path of the public tokenizer's file, as the workers' installation has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, length): the first piece takes what doesn't fill one."""
    first = len(ids) % size or size
    return [(0, first), *((s, size) for s in range(first, len(ids), size))]


SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), end_id: int = 2, path: str | None = None, buffer: int = 32_768) -> DataFrame:
    """Pieces of docs (doc_id, text, ...) and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokenizer(path or vocabulary()), TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            ids, number, start, length, crc = zip(*held, strict=True)
            sequence, offset = pack(np.array(length, dtype=np.int64), capacity)
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(sequence + base), pa.array(offset)], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])
            base += int(sequence.max()) + 1
            held.clear()
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    held += [(doc_id, n, start, size, zlib.crc32(ids[start : start + size].tobytes())) for n, (start, size) in enumerate(pieces(ids, capacity.tokens))]
                    if len(held) >= buffer:
                        yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document of the table, packed into sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
