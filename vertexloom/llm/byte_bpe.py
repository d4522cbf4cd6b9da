"""Byte-level BPE encoding and decoding, by the tokenizers library over Arrow batches.

A rank file gives each token's bytes and rank. Bytes are written as characters, as byte-level vocabularies do, so that the
library's BPE can run on them. Its merges are all pairs of tokens that make up a token, in the order of the made token's
rank, and a piece that is a token is taken whole: that is how rank files are meant to be read. Texts are cut by the
file's pattern; a worker remembers the ids of at most MEMO pieces of at most LONG characters, so the library
encodes each common piece once for a worker and every other piece where it stands. Texts are independent: nothing is
shuffled, and hot sources or copies have no effect.

Encoding gives ids with their offsets in the text, in code points. Where a character's bytes are split over tokens, each of
them has the whole character as its range. Decoding turns ids into bytes by the reversed table and joins them before
characters are read, so split characters come back; `texts_of_tokens` gives each character to the token that completes it.

Which characters are letters, numbers and spaces is asked of the installed tiktoken, as Unicode versions differ between
libraries.

Defined results: null counts as empty; an empty text has no tokens and decodes to no bytes; a null doc_id is carried; repeated
rows are encoded each; further columns are ignored; an empty table gives no rows; null ids decode to null; an id that the
file doesn't hold raises KeyError.
"""

from __future__ import annotations

import base64
import codecs
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 128
MEMO = 1 << 17
LONG = 64


def vocabulary() -> str:
    """Path of the public rank file, as the workers' installation has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def character_of_byte() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """{token: rank} of a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _differences(name: str) -> tuple[str, str]:
    """Characters that tiktoken has in the class and `regex` hasn't, and the other way round, for \\p{L} or \\p{N}."""
    import tiktoken

    single = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    own, more, less = regex.compile(name), "", ""
    for start in range(0, sys.maxunicode + 1, 4096):
        block = "".join(map(chr, (c for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)))
        theirs, ours = set(bytes(single.encode_ordinary(block)).decode()), set(own.findall(block))
        more, less = more + "".join(sorted(theirs - ours)), less + "".join(sorted(ours - theirs))
    return more, less


def _listed(characters: str) -> str:
    """The sorted characters as ranges of a character class."""
    codes = np.array([ord(c) for c in characters])
    breaks = np.flatnonzero(np.diff(codes) > 1)
    starts, ends = codes[np.r_[0, breaks + 1]], codes[np.r_[breaks, len(codes) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


class Splitter:
    """Matches of a pattern in a text, with tiktoken's letters and numbers."""

    def __init__(self, pattern: str):
        self.plain, careful = regex.compile(pattern), "(?V1)" + pattern
        self.odd = np.zeros(sys.maxunicode + 1, dtype=bool)
        for name in (r"\p{L}", r"\p{N}"):
            more, less = _differences(name)
            self.odd[np.array([*map(ord, more + less)], dtype=np.int64)] = True
            own = f"[{name}--[{_listed(less)}]]" if less else name
            careful = careful.replace(name, f"[{own}||[{_listed(more)}]]" if more else own)
        self.careful = regex.compile(careful)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any():
            return self.plain.findall(text)
        return self.careful.findall(text)


class Codec:
    """Encoding and decoding by one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        written, ranks = character_of_byte(), read_ranks(path)
        as_text = {token: "".join(written[b] for b in token) for token in ranks}
        pairs = (
            (as_text[token[:i]], as_text[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        )
        vocab = {as_text[token]: rank for token, rank in ranks.items()}
        self.model = models.BPE(vocab=vocab, merges=list(pairs), ignore_merges=True)
        self.split = Splitter(pattern)
        self.written = dict(enumerate(written))
        byte_of = {c: b for b, c in enumerate(written)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.sizes = np.zeros(max(self.bytes_of, default=0) + 1, dtype=np.int64)
        self.sizes[list(self.bytes_of)] = [len(token) for token in self.bytes_of.values()]
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        data = piece if piece.isascii() else piece.encode().decode("latin-1")  # a character for each byte
        found = tuple([token.id for token in self.model.tokenize(data.translate(self.written))])
        if len(piece) <= LONG:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of a text."""
        known = self.memo.get
        ids = np.fromiter(chain.from_iterable([known(p) or self.piece(p) for p in self.split(text)]), np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if not text.isascii():
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return ids, starts.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def texts_of_tokens(self, ids: list[int]) -> list[str]:
        """Each token's characters; one split over tokens belongs to the token that completes it. Bytes that are no UTF-8 read as U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes_of[i], final=n == len(ids)) for n, i in enumerate(ids, 1)]


@cache
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(path or vocabulary(), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, back: bool = False) -> DataFrame:
    """doc_id, ids, and starts and ends of the tokens in code points, of docs (doc_id, text, ...).

    With back, also bytes: what the ids decode to, by the same worker, so that a task needs one worker and one table of
    tokens, and no more than SLICE texts are decoded at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "starts", "ends", *(["bytes"] if back else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids, starts, ends = zip(*(own.encode(t or "") for t in some.column(1).to_pylist()), strict=True)
                borders = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(borders, pa.array(np.concatenate(x))) for x in (ids, starts, ends)]
                if back:
                    lists.append(pa.array([own.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([some.column(0), *lists], names)

    slim = docs.select("doc_id", F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>{', bytes binary' if back else ''}")


def decoded(ids: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes of a column of ids."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([None if row is None else own.decode(row.tolist()) for row in rows], dtype=object)

    return run(ids)


def decoded_text(ids: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """The same as a string; bytes that are no UTF-8, as where ids begin or end within a character, read as U+FFFD."""
    return F.make_valid_utf8(decoded(ids, path, pattern).cast("string"))


def texts_of_tokens(ids: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """An array with the characters of each token of a column of ids."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        own = codec(path, pattern)
        return pd.Series([None if row is None else own.texts_of_tokens(row.tolist()) for row in rows], dtype=object)

    return run(ids)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the bytes that they decode to."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), back=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
