"""A corpus pipeline in five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its
predecessor kept. All but the last return the columns of ``documents``; further columns, whatever
their names, are kept too. Texts are read whole, whatever their length, and an empty table gives an
empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, packing, quality, secrets, simhash
from plumbline.llm.common import materialise_alone, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; a document that lost too much, is too short or repeats itself goes.

    A null or empty text has no words, so its row goes; repeated rows are judged alike; other
    columns may be null; ``n_chars`` follows the text.
    """
    return quality.keep_good(docs, count_col="n_chars")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one of the smallest id.

    Null counts as empty, and the empty texts are one group; a null id ranks last; of rows that
    nothing tells apart one stays.
    """
    return exact_dedup.keep_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarity of 0.8 or more stays, that of the
    smallest id.

    Null and empty texts are in no group and stay, and so do rows whose id is null or isn't unique.
    """
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced; all documents stay.

    Null and empty texts have none; a null ``source`` is an owner of its own; repeated rows are changed
    alike; ``n_chars`` follows the text.
    """
    return secrets.redact(docs, count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, one row per piece.

    A null or empty text is the end token alone; repeated rows are packed again; a null id stays null.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near-duplicate removal", near_copies),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: SQL can express neither the line rules nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, make = docs, stage
        docs = materialise_alone(lambda: make(spark, before, sf_dir), name.replace(" ", "-"))  # noqa: B023 - called at once
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
