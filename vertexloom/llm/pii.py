"""Personal data behind disguises, with spans in the source text.

Transducers rewrite a text step by step: homoglyphs and hidden characters, spelled digits, at/dot
disguises. Each step gives a new text together with the source range of every character in it, so the
steps compose and a match in the last text maps back to code points of the first. Plain identifiers are
found in the source itself and always stay; a match in the rewritten text adds a span where it took a
rewrite to see it and no plain one of its kind overlaps it, unless it holds all of that one and more.

Plain kinds, leftmost and non-overlapping: e-mail addresses; IPv4 addresses (parts up to 255); card numbers
(13 to 19 digits that pass Luhn's check); telephone numbers with a plus sign (9 to 15 digits). A match that
fails its check is dropped without a retry. Scans are linear, whatever the text's length.

Defined results: null counts as empty; a text without identifiers gives zeros, the hash of an empty string and
an empty span list; rows repeat as they come, a null doc_id as it is; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 256
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOK_ALIKES = dict(zip("аесорхуіјѕһԁԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνɑıℓ", "aecopxyijshdqwABEKMHOPCTXIJSABEZHIKMNOPTYXopvail", strict=True))
_HIDDEN = "​‌‍⁠﻿­"
#: Digits, signs and the words for "at" and "dot" in English, German, French and Spanish (fixed values).
_SPOKEN = (
    "zero null zéro cero oh", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_DIGITS = {word: str(digit) for digit, words in enumerate(_SPOKEN) for word in words.split()}
_AT_WORDS = "at|arobase|arroba|klammeraffe"
_DOT_WORDS = "dot|punkt|point|punto"
_SIGNS = {"plus": "+", "más": "+", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "dash": "-", "hyphen": "-", "strich": "-", "tiret": "-", "guion": "-"}
_WORD = "|".join(_DIGITS)
_ITEM = rf"(?:{_WORD}|[0-9]++)"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|más)[\s,-]+|\+[\s,-]*)?{_ITEM}(?![^\W_])(?:[\s,-]+(?:{_ITEM}|{'|'.join(_SIGNS)})(?![^\W_]))*", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\+")
_AT = rf"(?:\s*[\[({{<]\s*(?:{_AT_WORDS}|@)\s*[\])}}>]\s*)"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_DOT_WORDS}|\.)\s*[\])}}>]\s*)"
#: A bracketed "at" takes any dot after it; a bare one needs a disguised dot too, as in "x at y dot z".
_ANCHOR = re.compile(rf"(?P<sure>{_AT}|@)|(?P<bare>\s+(?:{_AT_WORDS})\s+)", re.IGNORECASE)
#: Which words for "dot" go with which "at": in other languages they are words like any other.
_DOTS_OF = {"at": "dot|punkt", "arobase": "point", "arroba": "punto", "klammeraffe": "punkt", "@": "dot|punkt|punto"}


def _parts(words: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What follows an "at", what precedes it (read from right to left), and the dots in both."""
    said, back = rf"\s+(?:{words})\s+", "|".join(w[::-1] for w in words.split("|"))
    back_any = "|".join(w[::-1] for w in _DOT_WORDS.split("|"))
    back_dot = rf"\s*[\])}}>]\s*(?:{back_any}|\.)\s*[\[({{<]\s*|\s+(?:{back})\s+"
    host = rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT}|{said})[A-Za-z0-9-]++)+"
    name = rf"[A-Za-z0-9._%+-]++(?:(?:{back_dot})[A-Za-z0-9._%+-]++)*+"
    return tuple(re.compile(x, re.IGNORECASE) for x in (host, name, f"{_DOT}|{said}"))


_BRACKETS = re.compile(r"[\s\[\](){}<>]+")
_PARTS = {at: _parts(words) for at, words in _DOTS_OF.items()}
_ANY_DOT = re.compile(_DOT, re.IGNORECASE)
_BARE = re.compile(rf"\s(?:{_DOT_WORDS})\s")
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)\s*[\])}}>]")
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_DIGIT_WORDS = frozenset(w.encode() for w in _DIGITS)
_SIGN_WORDS = frozenset(w.encode() for w in _SIGNS)
_DOTS = tuple(_DOT_WORDS.split("|"))
#: What isn't a Latin letter, common punctuation or a currency sign; hidden characters and look-alikes are among it.
_ODD = re.compile("[^\\x00-\\xac\\xae-\\u0130\\u0132-\\u0250\\u1e00-\\u1eff\\u2010-\\u2027\\u2030-\\u205f\\u20a0-\\u20cf]")
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]++(?:{_DOT}[0-9]++){{3}}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield "email", start, last
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, by kind and start."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or "0") < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


@dataclass
class Rewritten:
    """A text whose character i stands for source[starts[i]:ends[i]]."""

    text: str
    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, text: str) -> Rewritten:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace [a, b) by a string for each edit; edits are in order and apart."""
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        parts.append(self.text[last:])
        return Rewritten("".join(parts), starts + self.starts[last:], ends + self.ends[last:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


@cache
def _homoglyphs() -> dict[str, str]:
    """Characters to their plain forms: wide and mathematical forms and other scripts' decimal digits by rule."""
    table = dict(_LOOK_ALIKES)
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x660, 0xFF1A)):
        c = chr(code)
        if unicodedata.decimal(c, None) is not None:
            table[c] = str(unicodedata.decimal(c))
        elif not 0x660 <= code < 0xFF01:
            simple = unicodedata.normalize("NFKC", c)
            if len(simple) == 1 and simple.isascii():
                table[c] = simple
    return table | dict.fromkeys(_HIDDEN, "")


def _see_through_glyphs(now: Rewritten) -> Rewritten:
    if not _ODD.search(now.text):
        return now
    table = _homoglyphs()
    edits = [(i, i + 1, table[c]) for i, c in enumerate(now.text) if c in table]
    return now.edit(edits) if edits else now


def _read_spelled_digits(now: Rewritten) -> Rewritten:
    """Runs of digits of which some are spelled: three spelled ones, or one among four in all; what separates them goes."""
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED.finditer(now.text):
        items = [(t.start() + m.start(), t.end() + m.start(), t[0].lower()) for t in _TOKEN.finditer(m[0])]
        while items and items[-1][2] in _SIGNS:  # a sign at the end joins nothing
            items.pop()
        spelled = sum(t in _DIGITS for *_, t in items)
        if not spelled or spelled < 3 and spelled + sum(len(t) for *_, t in items if t[0].isdigit()) < 4:
            continue
        for (a, b, t), after in zip(items, [*items[1:], None], strict=True):
            if t in _DIGITS or t in _SIGNS:
                edits.append((a, b, _DIGITS.get(t) or _SIGNS[t]))
            if after and after[0] > b:
                edits.append((b, after[0], ""))
    return now.edit(edits) if edits else now


def _undo_at_and_dot(now: Rewritten) -> Rewritten:
    low = now.text.lower()
    if not (_BARE.search(low) or _BRACKETED.search(low)):
        return now
    edits: dict[int, tuple[int, int, str]] = {}
    back, size = now.text[::-1], len(now.text)
    for m in _ANCHOR.finditer(now.text):
        of_host, of_name, of_dot = _PARTS[_BRACKETS.sub("", m[0].lower())]
        host = of_host.match(now.text, m.end())
        name = of_name.match(back, size - m.start()) if host else None
        if not name:
            continue
        dots = [d.span() for part in ((size - name.end(), m.start()), host.span()) for d in of_dot.finditer(now.text, *part)]
        if m["bare"] and not any(a >= m.end() for a, _ in dots):
            continue
        if m["sure"] != "@":
            edits[m.start()] = (*m.span(), "@")
        edits.update({a: (a, b, ".") for a, b in dots})
    for m in _DOTTED.finditer(now.text):
        edits.update({d.start(): (*d.span(), ".") for d in _ANY_DOT.finditer(now.text, *m.span())})
    kept, last = [], 0
    for a, b, new in (edits[a] for a in sorted(edits)):
        if a >= last:  # what overlaps an earlier one is left
            kept.append((a, b, new))
            last = b
    return now.edit(kept) if kept else now


def _may_hide(text: str) -> bool:
    """Whether a step could rewrite anything, by cheap tests first."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    if any(d in low for d in _DOTS) and _BARE.search(low) or any(c in text for c in "[({<") and _BRACKETED.search(low):
        return True
    if not any(w in low for w in _DIGITS):
        return False
    # what is rewritten has four digits in a run, or three spelled ones
    words = low.encode().translate(_APART).split()
    if _DIGIT_WORDS.isdisjoint(words):
        return False
    spoken = [w in _DIGIT_WORDS or w in _SIGN_WORDS or w.isdigit() for w in words]
    return any(a and b for a, b in zip(spoken, spoken[1:], strict=False))


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that take a rewrite to see, apart from known ones of their kind or wider than those they hold."""
    if not _may_hide(text):
        return []
    now = Rewritten.of(text)
    first = now
    for step in (_see_through_glyphs, _read_spelled_digits, _undo_at_and_dot):
        now = step(now)
    if now is first:
        return []
    out = []
    ends = {k: [e for x, _, e in known if x == k] for k in KINDS}
    starts = {k: [s for x, s, _ in known if x == k] for k in KINDS}
    for kind, a, b in plain(now.text):
        start, end = now.source(a, b)
        first, last = bisect_right(ends[kind], start), bisect_left(starts[kind], end)
        met = list(zip(starts[kind][first:last], ends[kind][first:last], strict=True))
        if text[start:end] != now.text[a:b] and all(start <= s and e <= end and (start, end) != (s, e) for s, e in met):
            out.append((kind, start, end))
    return out


def identifiers(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by kind and start."""
    base = plain(text or "")
    every = sorted(base + disguised(text or "", base), key=lambda s: (KINDS.index(s[0]), s[1:]))
    return base, every


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_identifiers(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, plain, value) of each row of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some, out = batch.slice(start, SLICE), []
                for text in some.column(1).to_pylist():
                    base, every = identifiers(text)
                    own = set(base)
                    out.append([{"kind": s[0], "start": s[1], "end": s[2], "plain": s in own, "value": text[s[1] : s[2]]} for s in every])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,plain:boolean,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of all spans by kind, the hash of the plain ones' list, and the list of all."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    base = text(F.filter("spans", lambda s: s.plain))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op3_offset_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of documents."""
    return digest(find_identifiers(spark.read.parquet(f"{sf_dir}/documents.parquet")))
