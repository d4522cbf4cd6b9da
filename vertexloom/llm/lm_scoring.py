"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts all words and pairs of words of the training fold. A count c is kept as its level 1 + floor(log_base c):
the n-gram is put into the filter together with each of the numbers 1 .. level. A reader asks for the n-gram with 1, 2,
... until the filter says no; the last yes is the level, and the level's mean count m takes the count's place.
Probabilities are smoothed from these by Dirichlet interpolation and add up to 1 but for the filter's errors:
p(w) = (m(w) + 1) / (M + V + 1), M the sum of m over all words, one unit left for words that training never saw;
p(w | h) = (m(hw) + mu p(w)) / (T(h) + mu), T(h) the sum of m(hw) over all words w after h. M and T are exact sums of
the level means, made when the filter is. Before a text stands its end token. A pair with a word that training never
saw isn't probed: it can't have been counted.

The filter is made of segments, dealt by the pair's first word and four bits of its second, whose number follows the
training text (segment_bytes each), so that none outgrows a task; each has bits_per_key bits for each of its own keys,
so the error rate is the same at every size.

What is broadcast is bounded, and what is larger has an exact way that gives the same scores:
- the filter of a training text of a few megabytes (at most max_bits for two bytes a token; every worker process holds it)
  and its vocabulary (at most max_vocabulary words) go to the workers, which probe text by text;
- else texts are read once and kept as places in their slice's words; slices of texts send the 64-bit keys of their
  distinct pairs and words to the segments once, for counts and questions together, and get levels and exact counts back.
  No vocabulary leaves the segments, so this is one plan whatever the number of words.

Defined results: null counts as empty; a text without words is the end token alone; a null doc_id is in the
training fold; repeated rows count as often as they come; with no training rows N = V = 0; further columns
are ignored, whatever their names; an empty table gives no rows; texts may have any length. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import kept

SLICE = 256
COUNTED = 1_000_000  # tokens whose pairs are summed before they leave a task
STRETCH = 1 << 17  # keys that are probed at a time
CACHED = 50_000  # words whose hashes a task remembers
SALTS = np.uint64(15)
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word has a space in it
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FILTER = "segment int, size long, bits binary, words binary, levels binary, heads binary, sums binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, each with its end; and where texts begin."""
    arrays, sizes = [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at 20, 09-0D
        arrays += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.array([END])]
        sizes.append(len(words) + 1)
    return np.concatenate(arrays) if arrays else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def before(tokens: np.ndarray, starts: np.ndarray, end) -> np.ndarray:
    """The token before each token; the end token before a text's first one."""
    out = np.roll(tokens, 1)
    out[starts[:-1]] = end
    return out


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(h * C1 + w)


def word_key(w: np.ndarray) -> np.ndarray:
    return mixed(w ^ C3)


def pair_segment(h: np.ndarray, w: np.ndarray, number: int) -> np.ndarray:
    """Segment of a pair: by its first word and some bits of the second, so that a common first word is spread."""
    return _scaled(mixed(h + (w & SALTS) * C2), number)


def word_segment(w: np.ndarray, number: int) -> np.ndarray:
    return _scaled(mixed(w * C2), number)


def _scaled(x: np.ndarray, number: int) -> np.ndarray:
    return (((x >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)).astype(np.int64)


def packed(x: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers from 0 as bytes, plane by plane, with as many planes (the first byte) as the greatest one needs; as
    differences if in order."""
    x = np.ascontiguousarray(np.diff(x, prepend=0) if ordered else x, dtype="<i8")
    planes = -(-int(x.max(initial=0)).bit_length() // 8)
    return bytes([planes]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[: max(1, planes)]).tobytes()


def unpacked(b: bytes, ordered: bool = False) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(max(1, b[0]), -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : len(planes)] = planes.T
    x = whole.view("<i8").reshape(-1)
    return np.cumsum(x) if ordered else x


@dataclass(frozen=True)
class Shape:
    """How the filter is built."""

    base: float = 1.5
    bits_per_key: int = 12
    number: int = 1

    @property
    def probes(self) -> int:
        return max(1, round(self.bits_per_key * np.log(2)))

    @property
    def means(self) -> np.ndarray:
        """Mean of the counts of each level; 0 for level 0."""
        bounds = [int(np.ceil(self.base**q - 1e-9)) for q in range(80)]
        return np.array([0.0, *((lo + max(lo, hi - 1)) / 2 for lo, hi in zip(bounds, bounds[1:], strict=False))])

    def levels(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.floor(np.log(counts) / np.log(self.base) + 1e-9).astype(np.int64)

    def filled(self, keys: np.ndarray, level: np.ndarray) -> tuple[int, np.ndarray]:
        """Number of bits and the bytes of a segment with these keys."""
        size = max(64, -(-int(level.sum()) * self.bits_per_key // 64) * 64)
        flags = np.zeros(size, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            for some in stretches(keys[level >= q]):
                start, step = stride(some, q)
                for i in range(self.probes):
                    flags[((start + np.uint64(i) * step) % np.uint64(size)).view(np.int64)] = True
        return size, np.packbits(flags, bitorder="little")


def stretches(x: np.ndarray) -> Iterator[np.ndarray]:
    """x in parts whose intermediate results stay small."""
    return (x[i : i + STRETCH] for i in range(0, len(x), STRETCH))


def stride(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit i of a key with a level is at start + i * step, modulo the segment's size."""
    h = mixed(keys + np.array([level], np.uint64) * C2)
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


@dataclass
class LogBloom:
    """Some segments of the filter: their sizes in bits, their first byte, and all bytes."""

    shape: Shape
    sizes: np.ndarray
    first: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, shape: Shape, sizes: list[int], bits: list[bytes]) -> LogBloom:
        lengths = np.array([len(b) for b in bits], np.int64)
        return cls(shape, np.array(sizes, np.uint64), np.cumsum(lengths) - lengths, np.frombuffer(b"".join(bits), np.uint8))

    def highest(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The highest level that the filter affirms for each key."""
        level, open_ = np.zeros(len(keys), dtype=np.int64), np.flatnonzero(self.sizes[segment] > 0)
        first, size = self.first[segment], self.sizes[segment]
        for q in range(1, 80):
            start, step = stride(keys[open_], q)
            for i in range(self.shape.probes):  # who fails one probe is asked no more
                at = ((start + np.uint64(i) * step) % size[open_]).view(np.int64)
                yes = (self.flat[first[open_] + (at >> 3)] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
                open_, start, step = open_[yes], start[yes], step[yes]
            if not len(open_):
                break
            level[open_] = q
        return level


@dataclass
class Words:
    """The known words in the order of their hashes: exact counts, levels and sums T as first words; one more entry,
    all zero, stands for unknown words."""

    known: np.ndarray
    counts: np.ndarray
    tokens: int
    mu: float
    level: np.ndarray | None = None
    sums: np.ndarray | None = None

    def __post_init__(self):
        self.n = len(self.known)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token's word; n for unknown ones."""
        if not self.n:
            return np.zeros(len(tokens), np.int64)
        unique, back = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), self.n - 1)
        return np.where(self.known[at] == unique, at, self.n)[back]

    def base(self, codes: np.ndarray) -> np.ndarray:
        return np.log10((self.counts[codes] + 1) / (self.tokens + self.n + 1))

    def single(self, codes: np.ndarray, means: np.ndarray) -> np.ndarray:
        """p(w)"""
        return (means[self.level[codes]] + 1) / (self.mass + self.n + 1)

    def joint(self, h: np.ndarray, w: np.ndarray, level: np.ndarray, means: np.ndarray) -> np.ndarray:
        """log10 p(w | h), given the pairs' levels."""
        return np.log10((means[level] + self.mu * self.single(w, means)) / (self.sums[h] + self.mu))

    def with_filter(self, level: np.ndarray, sums: np.ndarray, means: np.ndarray) -> Words:
        out = Words(self.known, self.counts, self.tokens, self.mu, level, sums)
        out.mass = float(means[level[:-1]].sum())
        return out


def held_out() -> F.Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"), F.lit(False))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order, of each number its place there, and of each distinct one a place where it stands; in
    half of the memory that np.unique takes."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
    unique, first = ordered[new], order[new]
    del ordered
    back = np.empty(len(x), np.int32 if len(x) < 1 << 31 else np.int64)
    back[order] = np.cumsum(new, dtype=back.dtype) - 1
    return unique, back, first


def narrow(x: np.ndarray, below: int) -> np.ndarray:
    """x, all less than below, in four bytes where that is enough."""
    return x.astype(np.int32 if below < 1 << 31 else np.int64)


def buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[pa.Buffer]:
    """The values of a binary column, where they are."""
    return (x.as_buffer() for x in column)


def release() -> None:
    """Give back what this worker has freed: it lives on beside the next stages, where the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    release()


def released_group(table: pa.Table) -> pa.Table:
    release()
    return table


def count_words(docs: DataFrame) -> DataFrame:
    """(key, count) over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _Hashes(), [], 0

        def give() -> pa.RecordBatch:
            key, count = _summed(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "count"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                held.append(tokens_of(batch.column(0).slice(start, SLICE).to_pylist(), hashes)[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield give()
                    size = 0
        if size:
            yield give()

    return docs.select("text").mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


def sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    """The places of x that aren't zero, and what stands there."""
    at = np.flatnonzero(x)
    return packed(at, True), x[at].astype("<f8").tobytes()


def _by_segment(segment: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal segments in a sorted array."""
    first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.empty(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(segment)), strict=True):
        yield int(segment[a]), slice(int(a), int(b))


def _dealt(segment: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each segment: its pairs (in order) and their counts."""
    order = np.argsort(segment, kind="stable")
    segment, pairs, counts = segment[order], pairs[order], counts[order]
    rows = [(s, packed(pairs[at], True), packed(counts[at])) for s, at in _by_segment(segment)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "pairs", "counts"])


def build_filter(train: DataFrame, words: DataFrame, shared: Broadcast, shape: Shape) -> DataFrame:
    """The filter's segments (FILTER): bits; words of the segment with their levels; first words with sums of level
    means. A pair is h * (n + 1) + w in codes; h = n stands for the word alone."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes, held, size = shared.value, _Hashes(), [], 0
        end = own.codes(np.array([END]))[0]

        def give() -> pa.RecordBatch:
            pair, count = _summed(np.concatenate(held))
            held.clear()
            h, w = own.known[pair // (own.n + 1)], own.known[pair % (own.n + 1)]
            return _dealt(pair_segment(h, w, shape.number), pair, count)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                tokens, starts = tokens_of(batch.column(0).slice(start, SLICE).to_pylist(), hashes)
                codes = own.codes(tokens)
                held.append(before(codes, starts, end) * (own.n + 1) + codes)
                size += len(codes)
                if size >= COUNTED:
                    yield give()
                    size = 0
        if size:
            yield give()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            key, count = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(key)
            key, count = key[order], count[order]
            yield _dealt(word_segment(key, shape.number), own.n * (own.n + 1) + own.codes(key), count)

    def filled(table: pa.Table) -> pa.Table:
        own, means = shared.value, shape.means
        pair, count = _summed(np.concatenate([unpacked(b, True) for b in table["pairs"].to_pylist()]), np.concatenate([unpacked(b) for b in table["counts"].to_pylist()]))
        h, w = pair // (own.n + 1), pair % (own.n + 1)
        lone = h == own.n
        keys = np.where(lone, word_key(own.known[w]), pair_key(own.known[np.where(lone, 0, h)], own.known[w]))
        level = shape.levels(count)
        size, bits = shape.filled(keys, level)
        seen = LogBloom.of(shape, [size], [bits.tobytes()]).highest(keys[lone], np.zeros(int(lone.sum()), np.int64))
        heads, sums = _summed(h[~lone], means[level[~lone]])
        row = [table["segment"][0].as_py(), size, bits.tobytes(), packed(w[lone], True), packed(seen), packed(heads, True), sums.astype("<f8").tobytes()]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in FILTER.split(", ")])

    schema = "segment int, pairs binary, counts binary"
    rows = train.select("text").mapInArrow(pairs, schema).unionByName(words.mapInArrow(alone, schema))
    return kept(rows.groupBy("segment").applyInArrow(filled, FILTER))


def word_values(filter_: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of all words and sums T, by code; the last entry is that of unknown words."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, levels, heads, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, of = unpacked(words, True), unpacked(heads, True)
                code = np.concatenate([at, of])
                level, total = np.zeros(len(code), np.int64), np.zeros(len(code))
                level[: len(at)], total[len(at) :] = unpacked(levels), np.frombuffer(sums, "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(level), pa.array(total)], ["code", "level", "total"])

    rows = filter_.select("words", "levels", "heads", "sums").mapInArrow(taken, "code long, level long, total double")
    table = rows.groupBy("code").agg(F.max("level").cast("byte").alias("level"), F.sum("total").alias("total")).toArrow()
    level, sums = np.zeros(n + 1, np.int8), np.zeros(n + 1)
    code = table["code"].to_numpy()
    level[code], sums[code] = table["level"].to_numpy(), table["total"].to_numpy()
    return level, sums


def score_texts(texts: list, hashes: _Hashes, own: Words, ask) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of each text; ask(h, w) gives the levels of pairs of codes of known words."""
    tokens, starts = tokens_of(texts, hashes)
    codes = own.codes(tokens)
    h = before(codes, starts, own.codes(np.array([END]))[0])
    means = own.means
    open_ = (h < own.n) & (codes < own.n)
    level = np.zeros(len(codes), np.int64)
    pair, back = np.unique(h[open_] * (own.n + 1) + codes[open_], return_inverse=True)
    level[open_] = ask(pair // (own.n + 1), pair % (own.n + 1))[back]
    each = lambda x: np.add.reduceat(x, starts[:-1]) if len(codes) else np.empty(0)
    return np.diff(starts), each((codes < own.n).astype(np.int64)), each(own.base(codes)), each(own.joint(h, codes, level, means))


def _columns(n, known, base, score, own: Words) -> list[pa.Array]:
    return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), own.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]


NAMES = ["doc_id", *(x.split()[0] for x in OUT.split(", "))]


def probed_by_workers(rows: DataFrame, filter_: DataFrame, shared: Broadcast, shape: Shape, schema: str) -> DataFrame:
    """Scores with the whole filter at every worker."""
    sizes, bits = [0] * shape.number, [b""] * shape.number
    for row in filter_.select("segment", "size", "bits").collect():
        sizes[row.segment], bits[row.segment] = row.size, bytes(row.bits)
    bloom = rows.sparkSession.sparkContext.broadcast(LogBloom.of(shape, sizes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, hashes = shared.value, bloom.value, _Hashes()

        def ask(h: np.ndarray, w: np.ndarray) -> np.ndarray:
            a, b = own.known[h], own.known[w]
            return table.highest(pair_key(a, b), pair_segment(a, b, shape.number))

        for batch in batches:
            for start in range(0, batch.num_rows, 3 * SLICE):  # the more texts, the fewer pairs are looked up again
                some = batch.slice(start, 3 * SLICE)
                found = score_texts(some.column(2).to_pylist(), hashes, own, ask)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *_columns(*found, own)], NAMES)

    return rows.mapInArrow(run, schema)


def coded(rows: DataFrame) -> DataFrame:
    """Slices of about COUNTED tokens of rows (doc_id, held_out, text): the texts' columns, how many tokens they have, the
    words' hashes, most frequent first, and the tokens as places there."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["slice", "doc_id", "held_out", "sizes", "words", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, size = _Hashes(), 0, 0
        held: list[tuple] = []

        def give() -> pa.RecordBatch:
            ids, flags, tokens, sizes = zip(*held, strict=True)
            unique, back, _ = distinct(np.concatenate(tokens))
            order = np.argsort(-np.bincount(back, minlength=len(unique)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.chunked_array(x).combine_chunks()) for x in (ids, flags)]
            blobs = [packed(np.concatenate(sizes)), unique[order].tobytes(), packed(place[back])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + number]), *lists, *(pa.array([x], pa.binary()) for x in blobs)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                tokens, starts = tokens_of(some.column(2).to_pylist(), hashes)
                held.append((some.column(0), some.column(1), tokens, np.diff(starts)))
                size += len(tokens)
                if size >= COUNTED:
                    yield give()
                    size, number = 0, number + 1
        if held:
            yield give()

    return kept(rows.mapInArrow(lambda batches: released(run(batches)), f"slice long, doc_id array<{kind}>, held_out array<boolean>, sizes binary, words binary, codes binary"))


@dataclass
class Slice:
    """The tokens of a slice, its pairs in the order of their segments, and its words in that of theirs."""

    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    h: np.ndarray  # of each pair, the place of its first word
    w: np.ndarray
    pair: np.ndarray  # of each token, the pair that it ends
    pair_segment: np.ndarray
    order: np.ndarray  # of words
    word_segment: np.ndarray  # in that order

    @classmethod
    def of(cls, sizes: bytes | pa.Buffer, words: bytes | pa.Buffer, codes: bytes | pa.Buffer, number: int) -> Slice:
        size, word = unpacked(sizes), np.frombuffer(words, np.uint64)
        code = narrow(unpacked(codes), len(word))
        starts = np.concatenate([[0], np.cumsum(size)])
        unique, back, _ = distinct(before(code, starts, code[-1]).astype(np.int64) * len(word) + code)  # the last token is an end
        h, w = narrow(unique // len(word), len(word)), narrow(unique % len(word), len(word))
        del unique
        segment, of = narrow(pair_segment(word[h], word[w], number), number), narrow(word_segment(word, number), number)
        order, words_order = np.argsort(segment, kind="stable"), np.argsort(of, kind="stable")
        place = np.empty(len(order), back.dtype)
        place[order] = np.arange(len(order), dtype=back.dtype)
        return cls(size, word, code, h[order], w[order], place[back], segment[order], words_order, of[words_order])


def probed_in_segments(rows: DataFrame, shape: Shape, mu: float, schema: str) -> DataFrame:
    """Scores with each segment in one task and no vocabulary outside them: each slice sends the keys of its pairs and its
    words once, with their counts in its training texts, to the segments; these add up, make their filter, and send back
    the level of every pair and the exact count and level of every word.

    T(h) is the count of h less what the level means of its pairs lack of their counts. That is nothing for counts up to
    3, so only other pairs are told: by the segment to one slice that has the pair, from there to the word's segment, and
    back to all slices that have the word. All rows on the way are arrays of a slice and a segment.
    """
    number, means = shape.number, shape.means
    slices = coded(rows)

    def asked_by(slice_: int, held: pa.ListScalar, own: Slice) -> pa.RecordBatch:
        train = np.repeat(~held.values.to_numpy(zero_copy_only=False), own.sizes)
        count, times = np.bincount(own.pair[train], minlength=len(own.h)), np.bincount(own.codes[train], minlength=len(own.words))[own.order]
        key, word = pair_key(own.words[own.h], own.words[own.w]), own.words[own.order]
        out = {s: (packed(own.h[at], True), key[at].tobytes(), packed(count[at]), b"", b"") for s, at in _by_segment(own.pair_segment)}
        for s, at in _by_segment(own.word_segment):
            out[s] = (*out.get(s, (b"",) * 5)[:3], word[at].tobytes(), packed(times[at]))
        columns = [pa.array([x[i] for x in out.values()], pa.binary()) for i in range(5)]
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([slice_] * len(out), pa.int64()), *columns], asked_names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, held, *blobs in zip(*batch.columns[:2], *map(buffers, batch.columns[2:]), strict=True):
                yield asked_by(slice_.as_py(), held, Slice.of(*blobs, number))  # one slice at a time is in memory

    asked_names = ["segment", "slice", "heads", "keys", "counts", "words", "times"]

    def added(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """All keys, their sums, of each sent key its place, of each key one that was sent; and where rows begin."""
        starts = np.cumsum([0, *(k.size // 8 for k in buffers(keys))])
        key, back, first = distinct(np.frombuffer(b"".join(buffers(keys)), np.uint64))
        count = np.zeros(len(key), np.int64)
        for c, a, b in zip(buffers(counts), starts, starts[1:], strict=False):
            if b > a:
                np.add.at(count, back[a:b], unpacked(c))
        return key, count, back, first, starts

    def answered(table: pa.Table) -> pa.Table:
        key, count, back, first, starts = added(table["keys"], table["counts"])
        word, n, word_back, _, word_starts = added(table["words"], table["times"])
        taught, known = count > 0, n > 0
        lone, true = word_key(word), np.zeros(len(key), np.int64)
        true[taught] = shape.levels(count[taught])
        size, bits = shape.filled(np.concatenate([key[taught], lone[known]]), np.concatenate([true[taught], shape.levels(n[known])]))
        bloom = LogBloom.of(shape, [size], [bits.tobytes()])
        level = np.concatenate([np.empty(0, np.int64), *(bloom.highest(some, np.zeros(len(some), np.int64)) for some in stretches(key))])
        seen = np.zeros(len(word), np.int64)
        seen[known] = bloom.highest(lone[known], np.zeros(int(known.sum()), np.int64))
        lack = count - means[true]
        told = np.zeros(len(back))
        told[first] = lack
        out = []
        for i, head in enumerate(buffers(table["heads"])):
            at, own = slice(starts[i], starts[i + 1]), slice(word_starts[i], word_starts[i + 1])
            some = np.flatnonzero(told[at])
            head = unpacked(head, True)[some] if len(some) else np.empty(0, np.int64)
            out.append((packed(level[back[at]]), packed(n[word_back[own]]), packed(seen[word_back[own]]), packed(head, True), told[at][some].tobytes()))
        once = lambda x, kind: pa.array([x] + [0] * (len(out) - 1), kind)
        columns = [table["slice"].combine_chunks(), table["segment"].combine_chunks(), *(pa.array([x[i] for x in out], pa.binary()) for i in range(5))]
        return pa.table([*columns, once(int(n.sum()), pa.int64()), once(int(known.sum()), pa.int64()), once(float(means[seen].sum()), pa.float64())], [x.split()[0] for x in answer.split(", ")])

    answer = "slice long, segment int, levels binary, times binary, seen binary, heads binary, lacks binary, tokens long, known long, mass double"
    asked = slices.select("slice", "held_out", "sizes", "words", "codes").mapInArrow(lambda batches: released(sent(batches)), "segment int, slice long, heads binary, keys binary, counts binary, words binary, times binary")
    answers = kept(asked.groupBy("segment").applyInArrow(lambda table: released_group(answered(table)), answer))
    del asked
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()  # Spark drops the keys' shuffle files, larger than the input, as their plan is collected
    tokens, known, mass = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "known", "mass"))).first()

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        """What a slice was told that its words lack; all its words by segment."""
        word = np.frombuffer(left["words"][0].as_buffer(), np.uint64)
        lack = np.zeros(len(word))
        for heads, lacks in zip(buffers(right["heads"]), buffers(right["lacks"]), strict=True):
            np.add.at(lack, unpacked(heads, True), np.frombuffer(lacks, np.float64))
        of = word_segment(word, number)
        order = np.argsort(of, kind="stable")
        word, lack = word[order], lack[order]
        out = [(s, word[at].tobytes(), *sparse(lack[at])) for s, at in _by_segment(of[order])]
        columns = [pa.array([x[i] for x in out], pa.int32() if not i else pa.binary()) for i in range(4)]
        return pa.table([columns[0], pa.array([left["slice"][0].as_py()] * len(out), pa.int64()), *columns[1:]], ["segment", "slice", "words", "places", "lacks"])

    def told(table: pa.Table) -> pa.Table:
        """What each word of a segment lacks in all, for every slice that has it."""
        starts = np.cumsum([0, *(x.size // 8 for x in buffers(table["words"]))])
        word, back, _ = distinct(np.frombuffer(b"".join(buffers(table["words"])), np.uint64))
        lack = np.zeros(len(word))
        for start, places, lacks in zip(starts, buffers(table["places"]), buffers(table["lacks"]), strict=False):
            np.add.at(lack, back[start + unpacked(places, True)], np.frombuffer(lacks, np.float64))
        out = [sparse(lack[back[a:b]]) for a, b in zip(starts, starts[1:], strict=False)]
        return pa.table([table["slice"], table["segment"], *(pa.array([x[i] for x in out], pa.binary()) for i in range(2))], ["slice", "segment", "places", "lacks"])

    by_slice = slices.select("slice", "words").groupBy("slice")
    lacks = answers.where(F.length("lacks") > 0).select("slice", "heads", "lacks").groupBy("slice")
    of_slices = by_slice.cogroup(lacks).applyInArrow(lambda left, right: released_group(placed(left, right)), "segment int, slice long, words binary, places binary, lacks binary")
    of_words = of_slices.groupBy("segment").applyInArrow(lambda table: released_group(told(table)), "slice long, segment int, places binary, lacks binary")
    own_answers = answers.select("slice", "segment", "levels", "times", "seen")
    every = own_answers.unionByName(of_words, allowMissingColumns=True)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Slice.of(*(left[c][0].as_buffer() for c in ("sizes", "words", "codes")), number)
        right = right.sort_by("segment")
        from_segments, of_words = right.filter(pc.is_valid(right["levels"])), right.filter(pc.is_valid(right["lacks"]))
        level, n, seen = (np.concatenate([unpacked(x) for x in buffers(from_segments[c])]) for c in ("levels", "times", "seen"))
        count, word_level, total = (np.zeros(len(own.words), np.int64) for _ in range(3))
        count[own.order], word_level[own.order] = n, seen
        total = count.astype(np.float64)
        first = np.searchsorted(own.word_segment, of_words["segment"].to_numpy())
        for start, places, lacks in zip(first, buffers(of_words["places"]), buffers(of_words["lacks"]), strict=True):
            total[own.order[start + unpacked(places, True)]] -= np.frombuffer(lacks, np.float64)
        level = np.where((count[own.h] > 0) & (count[own.w] > 0), level, 0)
        single = (means[word_level] + 1) / (mass + known + 1)
        joint = np.log10((means[level] + mu * single[own.w]) / (total[own.h] + mu))
        base = np.log10((count + 1) / (tokens + known + 1))
        starts = np.cumsum(own.sizes) - own.sizes
        each = lambda x: np.add.reduceat(x, starts)
        found = [own.sizes, each((count > 0).astype(np.int64)[own.codes]), np.full(len(starts), tokens), each(base[own.codes]), each(joint[own.pair])]
        ids, flags = (left[c].combine_chunks().flatten() for c in ("doc_id", "held_out"))
        return pa.table([ids, flags, *map(pa.array, found)], NAMES)

    return slices.groupBy("slice").cogroup(every.groupBy("slice")).applyInArrow(lambda left, right: released_group(scored(left, right)), schema)


def score_documents(docs: DataFrame, mu: float = 100.0, base: float = 1.5, bits_per_key: int = 12, max_bits: int = 1 << 26, max_vocabulary: int = 8_000_000, segment_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text, ...)."""
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = rows.where("not held_out")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}"
    size = int(train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    shape = Shape(base, bits_per_key, max(1, -(-size // segment_bytes)))
    if size * bits_per_key > max_bits:  # a token takes two bytes at least, and adds a word's and a pair's level at most
        return probed_in_segments(rows, shape, mu, schema)
    words = kept(count_words(train))
    tokens, known = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if known > max_vocabulary:
        return probed_in_segments(rows, shape, mu, schema)
    shared = rows.sparkSession.sparkContext.broadcast
    table = words.toArrow()
    key, count = table["key"].to_numpy().view(np.uint64), table["count"].to_numpy()
    order = np.argsort(key)
    small = np.int32 if count.max(initial=0) < 1 << 31 else np.int64
    own = Words(key[order], np.append(count[order], 0).astype(small), int(tokens), mu)
    first = shared(own)
    filter_ = build_filter(train, words, first, shape)
    first.destroy()  # workers hold one vocabulary, not two; the filter is written by now
    own = own.with_filter(*word_values(filter_, own.n), shape.means)
    own.means = shape.means
    return probed_by_workers(rows, filter_, shared(own), shape, schema)


def op4_log_bloom_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
