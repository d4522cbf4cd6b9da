"""Runs of repeating words, by Kolpakov and Kucherov's algorithm.

A run is a stretch of words with smallest period q, at least `exponent` periods and `least` words long, that no
neighbouring word extends. For each text:

1. Cut. In such a run every gram of least * (1 - 2 / exponent) words stands again one period before or after, so words
   outside grams that repeat within the text are in no run, and each run lies within one stretch of the others. What
   follows works on these stretches; nothing is lost (tested).
2. Lempel-Ziv factors, each the longest prefix of the rest that starts earlier too, read from a suffix automaton whose
   states know where their words end first.
3. Main's step at each factor's start: the runs that cross it and end within the factor, and those that end there. Their
   periods are bounded by the two factors beside it. A period is a candidate if two neighbouring blocks of its length
   have the same hash; then the run is grown word by word, so a hash that errs costs time only.
4. Runs strictly inside a factor are copies of runs of its earlier occurrence.

Texts are independent, so each is worked on where it is read: nothing is shuffled and groups of copies have no effect. A
text's memory is some 60 bytes a word of its stretches, and what branches.

Defined results: null counts as empty, without words or runs; a blank text's words are none; a null doc_id is carried (and
never rewritten by `planted`); repeated rows are treated each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 128
FLUSH = 16 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words covered by grams that repeat in the text; the whole for gram < 1."""
    n = len(words)
    if gram < 1:
        return [(0, n)] if n else []
    if n <= gram:
        return []
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    hashed = mixed[: n - gram + 1].copy()
    for k in range(1, gram):
        hashed *= np.uint64(_BASE)
        hashed += mixed[k : n - gram + 1 + k]
    order = np.sort(hashed)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return []
    at = np.flatnonzero(np.isin(hashed, again))
    breaks = np.flatnonzero(np.diff(at) > gram)
    starts, ends = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + gram
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def factors(words: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors; a word's first occurrence is a factor without an earlier start (-1).

    States of the suffix automaton hold their first transition in arrays; only those that branch have a dict of the others.
    """
    room = 2 * len(words) + 1
    length, link, ends = (array("i", bytes(4 * room)) for _ in range(3))
    letter, target = array("i", [-1]) * room, array("i", bytes(4 * room))
    more: dict[int, dict[int, int]] = {}
    link[0], last, count = -1, 0, 1
    for i, c in enumerate(words):
        new, p, q = count, last, -1
        count += 1
        length[new], ends[new] = i + 1, i
        while p >= 0:
            seen = letter[p]
            if seen == c:
                q = target[p]
                break
            if seen < 0:
                letter[p], target[p] = c, new
            elif (others := more.get(p)) is None:
                more[p] = {c: new}
            elif c in others:
                q = others[c]
                break
            else:
                others[c] = new
            p = link[p]
        if q >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = count
                count += 1
                length[clone], link[clone], ends[clone] = length[p] + 1, link[q], ends[q]
                letter[clone], target[clone] = letter[q], target[q]
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0:
                    if letter[p] == c:
                        if target[p] != q:
                            break
                        target[p] = clone
                    elif (others := more.get(p)) is not None and others.get(c) == q:
                        others[c] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    start, n = 0, len(words)
    while start < n:
        state, at, earlier = 0, start, -1
        while at < n:
            c = words[at]
            state = target[state] if letter[state] == c else more[state][c]
            first = ends[state] - (at - start)
            if first >= start:
                break
            earlier, at = first, at + 1
        at = max(at, start + 1)
        yield start, at - start, earlier
        start = at


def _agree(words: np.ndarray, x: int, y: int, step: int) -> int:
    """How many words from x and from y on, x < y, going by step (1 or -1), are the same."""
    n, same, block = len(words), 0, 64
    while True:
        if step > 0:
            room = min(block, n - y - same)
            unlike = words[x + same : x + same + room] != words[y + same : y + same + room]
        else:
            room = min(block, x + 1 - same)
            unlike = (words[x + 1 - same - room : x + 1 - same] != words[y + 1 - same - room : y + 1 - same])[::-1]
        if room <= 0:
            return same
        found = int(unlike.argmax())
        if unlike[found]:
            return same + found
        same, block = same + room, block * 2


class _Blocks:
    """Equality of neighbouring blocks of a text, for many lengths at a time, by sums of powers modulo 2^64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.powers = np.ones(n + 1, dtype=np.uint64)
        self.powers[1:] = _BASE
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        np.add.accumulate((mixed ^ (mixed >> np.uint64(31))) * self.powers[:n], out=self.sums[1:])

    def same(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the q words from x on and the next q agree (if they do, this is true)."""
        middle = self.sums[x + q]
        return (middle - self.sums[x]) * self.powers[q] == self.sums[x + 2 * q] - middle


def _at_border(words: np.ndarray, blocks: _Blocks, before: int, border: int, after: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that cross the border between two factors and end in the second, or end at the border.

    `before` is where the first factor starts, `after` where the second ends. A run that crosses the border starts less than
    a period before `before`: else its rest after one period would have been one factor.
    """
    periods, places = [], []
    for limit, back in ((after - border) // 2, 0), (min(after - border, border), 1), (min(border - before - 1, border // 2), 2):
        if limit > 0:
            q = np.arange(1, limit + 1)
            x = border - back * q
            good = np.flatnonzero(blocks.same(x, q))
            periods.append(q[good])
            places.append(x[good])
    if not periods:
        return
    q, x = np.concatenate(periods), np.concatenate(places)
    order = np.argsort(q, kind="stable")
    q, x = q[order], x[order]
    while len(q):
        period, place = int(q[0]), int(x[0])
        end = place + period + _agree(words, place, place + period, 1)
        start = place - _agree(words, place - 1, place + period - 1, -1)
        if end - start >= 2 * period:
            if end - start >= max(least, exponent * period):
                yield start, end, period
            # multiples of this period within the same stretch say nothing new
            left = (q % period != 0) | (x < start) | (x + 2 * q > end)
            left[0] = False
            q, x = q[left], x[left]
        else:
            q, x = q[1:], x[1:]


def _runs(words: np.ndarray, exponent: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs of a text."""
    found: dict[tuple[int, int], int] = {}
    ordered: list[tuple[int, int]] = []
    blocks = _Blocks(words)

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in found:
            insort(ordered, (start, end))
            found[start, end] = period
        elif period < found[start, end]:
            found[start, end] = period

    before = border = 0
    for border, size, earlier in factors(words.tolist()):
        after, last = border + size, border - before
        if max(last + 2 * size, 2 * last + size) > least:
            for run in _at_border(words, blocks, before, border, after, exponent, least):
                add(*run)
        if earlier >= 0 and size >= least:
            at = bisect_right(ordered, (earlier, len(words)))
            while at < len(ordered) and ordered[at][0] < earlier + size:
                start, end = ordered[at]
                if end < earlier + size:
                    add(start + border - earlier, end + border - earlier, found[start, end])
                at += 1
        before = border
    for run in _at_border(words, blocks, before, len(words), len(words), exponent, least):
        add(*run)
    return found


def runs_of(words: np.ndarray, exponent: int = 3, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words given as numbers, by start, then period."""
    if exponent < 3 or least < 1:
        raise ValueError("runs of fewer than three periods aren't looked for")
    out = []
    for a, b in stretches(words, least * (exponent - 2) // exponent):
        if b - a >= max(least, exponent):
            out += [(a + s, e - s, q) for (s, e), q in _runs(np.ascontiguousarray(words[a:b]), exponent, least).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: list[tuple[int, int, int]]) -> Sequence[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, exponent: int = 3, least: int = 24) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts, held, first = [], [], [], 0, 0

            def flush(end: int) -> pa.RecordBatch:
                ids = batch.column(0).slice(first, end - first)  # noqa: B023
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())],  # noqa: B023
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

            for at in range(0, batch.num_rows, SLICE):
                for n, text in enumerate(batch.column(1).slice(at, SLICE).to_pylist(), at + 1):
                    words = (text or "").encode().split()  # bytes: by ASCII white space only
                    numbers: dict[bytes, int] = {}
                    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
                    own = runs_of(coded, exponent, least)
                    joined = b" ".join(collapsed(words, own))
                    counts.append(len(words))
                    found.append(own)
                    texts.append(joined)
                    held += len(joined)
                    if held > FLUSH:
                        yield flush(n)
                        counts, found, texts, held, first = [], [], [], 0, n
            if counts:
                yield flush(batch.num_rows)

    slim = docs.select("doc_id", F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs where one text in ten, by its doc_id's crc32, goes on from some word as a repeating passage.

    With h the crc32 and g = h div 10: if h is divisible by 10, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) div (3 + g % 8).
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.floor(hashed / 10).alias("g"),
        F.when(hashed % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"),
    )
    sized = chosen.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rewritten = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, its greatest run by exact exponent, and digests of all its runs and of its collapsed text."""
    found = find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    order = """(l, r) -> case when l.length * r.period > r.length * l.period then -1 when l.length * r.period < r.length * l.period then 1
               when l.start <> r.start then if(l.start < r.start, -1, 1) else cast(sign(l.period - r.period) as int) end"""
    top = found.withColumn("top", F.expr(f"get(array_sort(runs, {order}), 0)"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
