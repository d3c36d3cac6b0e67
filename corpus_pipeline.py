"""From raw documents to training sequences: five stages, each one operator of ``wikiloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm.mixing import mixed_documents
from wikiloom.llm.near_dup import without_near_duplicates
from wikiloom.llm.packing import pack_documents
from wikiloom.llm.pii import pseudonymous
from wikiloom.llm.quality import of_quality
from wikiloom.plans.shared import shared_table
from wikiloom.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"
#: The key of the demonstration; real runs bring their own.
PII_KEY = "wikiloom-demonstration-key"
#: Near duplicates from a similarity of 0.80 up; with 36 bands of 5 a pair at 0.80 is missed with probability < 1e-6.
NUMERATOR, BANDS, ROWS = 80, 36, 5


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1, as they are: nulls, extra columns and repeated rows stay.

    Null and empty texts have the score of a text without words; an empty table gives no rows.
    """
    return of_quality(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates; one row of those with equal id and text.

    Documents without a doc_id, or without words, have no duplicates and stay; different texts under one doc_id count
    as documents of their own; extra columns stay; an empty table gives no rows.
    """
    return without_near_duplicates(docs, numerator=NUMERATOR, bands=BANDS, rows=ROWS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal values replaced by pseudonyms; null and empty texts, repeated rows and extra columns stay; an
    empty table gives no rows."""
    return _measured(pseudonymous(docs, PII_KEY, spans=False)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: each document, whole, as often as its source's target asks; those without words are in it
    by their source's rate. A null source is a source; repeated rows share their copies; extra columns stay; a long text is
    in it whole or not at all; an empty table gives no rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens, a row for each piece of a document; a null or empty text has one token. Repeated rows
    are packed each; the columns of documents but doc_id go; an empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the network nor the tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
