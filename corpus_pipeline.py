"""From raw documents to packed training sequences, in five stages.

Each stage is one function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm.line_dedup import dedup_lines
from vertexloom.llm.mixing import mixed
from vertexloom.llm.packing import Capacity, pack_documents
from vertexloom.llm.similar import near_dedup
from vertexloom.llm.toxicity import drop_toxic, fit
from vertexloom.plans.lineage import kept


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labelled training fold, rejects go.

    A null or empty text scores like a text without matches and stays; repeated rows stay or go alike; further columns
    are returned untouched, whatever their names; without documents or labels nothing goes.
    """
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, give or take a word, go; so do documents left without a word by that.

    Null, empty and blank texts lose nothing and stay; rows that repeat doc_id and text are one document; of equal lines
    the one with the least (doc_id, text's hash, line number) stays; n_chars follows the text.
    """
    return dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (Jaccard similarity of five-word shingles 0.8 or more, in chains) the least doc_id stays.

    Texts without words, null ones too, are one group; rows without a doc_id stay; repeated rows of a doc_id stay or go
    together; further columns are returned untouched.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: sources weigh by the square root of their rows.

    A null source is a source of its own; null doc_ids and repeated rows are placed like any other; every row comes
    through once, with its columns untouched.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of at most 1024 tokens and 64 documents; a sequence draws on neighbours
    in the mixture's order.

    A null or empty text is its end token alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return pack_documents(docs, Capacity(documents=64))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages hold fitted scores, fingerprints and token ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
