"""The corpus pipeline: toxic documents out, near-copies and repeated passages out, secrets masked, the rest packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the
last return the columns of ``documents``; the last returns the packed pieces.
``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import best_fit, secret_scan, simhash, suffix_dedup, toxicity
from matchloom.llm.common import documents, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject; rows of null ids and texts are judged like any other."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group of near-duplicates; empty and null texts are one group."""
    return simhash.representatives(docs)


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in order, from (doc_id, text, rest)."""
    known = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return changed.select(*[(known[c] if c in known else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages, of ``suffix_dedup.PASSAGE`` bytes or more, that occur more than once; a null text becomes the empty text."""
    return _with_text(suffix_dedup.dedup(docs, suffix_dedup.PASSAGE, with_text=True), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; a null text becomes the empty text, rows of null ids are kept."""
    return _with_text(secret_scan.masked(secret_scan.scan(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in packed sequences; an empty text is one piece, a null id stays null."""
    return best_fit.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else materialize(out)
    return docs
