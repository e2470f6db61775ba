"""Helpers shared by the training-data operators.

Shared storage: intermediate tables go to the folder named by
``spark.checkpoint.dir`` (read from the session; in a single JVM, as in tests,
a folder of our own where the setting is absent). Every intermediate is an
ordinary Parquet table there, so a lost executor costs a retry of its tasks
and nothing else. The tables go when the session's JVM ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.shared import materialize

__all__ = ["documents", "id_and_text", "materialize", "small_batches", "text_column"]
#: Rows in an Arrow batch: bounds the memory of a Python worker for long texts.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Project to (doc_id, text): extra columns of any name never reach a kernel."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
