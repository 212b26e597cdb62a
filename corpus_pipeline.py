"""A corpus in five stages: rules, near duplicates, secrets, mix, tokens.

Each stage takes all documents that the one before kept and is applied to whole texts. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece_fst
from reachbase.llm.cluster import stored

#: The model of the last stage.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def keep_by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; each row is judged by itself.

    Null and empty texts go, very long ones are judged whole, a null lang is one more language,
    equal rows share their fate, an empty table stays empty; columns with any names are passed on.
    """
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Rows without an id or a word stay. Of rows with one id each goes by its own text, equal rows
    together. Very long texts are compared whole, an empty table stays empty, columns are passed on.
    """
    return near_dedup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the name of their kind, whatever their length; the documents stay.

    Null and empty texts and texts without secrets are as they were. Equal rows stay, an empty
    table stays empty, other columns are passed on.
    """
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, in which the training mix takes them.

    Null and empty texts are never taken; a null source is a source. Rows that differ in any
    column are documents of their own, equal ones have positions of their own; ties go by a hash
    of the row. An empty table stays empty, columns are passed on.
    """
    return mixing.training_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document of the mix; see encode_documents() for odd rows."""
    return sentencepiece_fst.encode_documents(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_by_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the near-duplicate groups nor the encoding; tests/llm compares
#: run() with a plain version of what stays, what is masked and how often it comes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
