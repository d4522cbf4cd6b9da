"""Fill-in-middle transformation of texts, in Arrow-batched pandas UDFs.

A text's units are its words with the white space before them, and white space at its end. The `regex` library's finditer
gives the ends of all units as a compact array; two of them, chosen by the document's seeds, cut the text into prefix, middle
and suffix. Seeds are hashlib's SHA-256 of the seed and the doc_id, so they depend on nothing else, and a lost task gives the
same rows again. Each text is worked on where it is read.

A text stays plain if it is empty or holds a marker, so that markers in an output are always the transformation's own and
`restore` gives the exact text back.

Defined results: null counts as empty; a null doc_id hashes as no digits; a text of white space alone is one unit; repeated rows are
treated alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKERS = ("<P>", "<S>", "<M>")


def seeds(doc_id: str | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def ends_of_units(text: str) -> array:
    """The code points at which units end, after a 0."""
    found = array("i", [0])
    found.extend(m.end() for m in UNIT.finditer(text))
    return found


def transform(doc_id: str | None, text: str, percent: int, spm_percent: int, seed: int, markers: Sequence[str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    first, second, chosen, order = seeds(doc_id, seed)
    ends = ends_of_units(text)
    n = len(ends) - 1
    if not text or chosen % 100 >= percent or any(m in text for m in markers):
        return n, "plain", None, None, text
    a, b = sorted((ends[first % (n + 1)], ends[second % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = markers
    if order % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def original(output: str, form: str, markers: Sequence[str]) -> str:
    """The text that `transform` gave this output for."""
    p, s, m = markers
    if form == "plain":
        return output
    if form not in ("spm", "psm"):
        raise ValueError(f"unknown form {form!r}")
    first, second = (s, p) if form == "spm" else (p, s)
    middle_at, second_at = output.find(m), output.find(second)
    if not output.startswith(first) or second_at < 0 or middle_at < second_at:
        raise ValueError("output without its markers")
    one, two, middle = output[len(first) : second_at], output[second_at + len(second) : middle_at], output[middle_at + len(m) :]
    return two + middle + one if form == "spm" else one + middle + two


def _checked(markers: Sequence[str]) -> tuple[str, ...]:
    """Markers that can't arise across their own borders: none holds another, and no end of one begins another."""
    found = tuple(markers)
    for a in found:
        for b in found:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError("three markers are needed that don't overlap")
    if len(set(found)) != 3:
        raise ValueError("three markers are needed that don't overlap")
    return found


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42, markers: Sequence[str] = MARKERS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and its digest output_sha256, of docs (doc_id, text, ...).

    `percent` of the texts are transformed, and of those `spm_percent` with the suffix first.
    """
    markers = _checked(markers)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(i, t or "", percent, spm_percent, seed, markers) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out = out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        return out.assign(output_sha256=[_sha256(t) for t in out["output"]])

    made = docs.select("doc_id", run(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("made"))
    return made.select("doc_id", "made.*")


def restore(made: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """made (output, form, ...) with the texts rebuilt from those two, `text`, and their digest `text_sha256`."""
    markers = _checked(markers)

    @F.pandas_udf("text string, text_sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [original(o, f, markers) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "text_sha256": [_sha256(t) for t in texts]})

    return made.withColumn("__restored", run("output", "form")).select("*", "__restored.*").drop("__restored")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, and digests of its output and of the text rebuilt from it."""
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("text_sha256").alias("restored_sha256"))
