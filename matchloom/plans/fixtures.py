"""Business records derived from the ``documents`` table: a deterministic stand-in for linkage inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country, is_ref) for all documents; reference where doc_id mod 3 is 0."""
    # The tenth item holds all that follows the nine words in use.
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.split(F.trim("text"), r"\s+", 10))
    doc = F.col("doc_id")
    words = lambda at, n: F.array_join(F.slice("t", at, n), " ")
    legal, street = doc % 5, doc % 4
    suffix = F.when(legal == 0, "Private Limited").when(legal == 1, "Pvt. Ltd.").when(legal == 2, "Corporation").when(legal == 3, "Corp").otherwise("")
    road = F.when(street == 0, " Road").when(street == 1, " Rd.").when(street == 2, " Street").otherwise(" Avenue")
    code = F.when(doc % 7 == 0, "").otherwise(F.concat(F.lit(", "), (10000 + (F.col("n_chars") * 37) % 90000).cast("string")))
    return d.select(
        F.concat(F.lit("S"), (1 + doc % 3).cast("string"), F.lit("-"), F.lpad(doc.cast("string"), 6, "0")).alias("entity_id"),
        F.trim(F.concat(words(1, 6), F.lit(" "), suffix)).alias("business_name"),
        F.concat((10 + doc % 90).cast("string"), F.lit(" "), words(7, 3), road, code).alias("business_address"),
        F.col("lang").alias("country"), (doc % 3 == 0).alias("is_ref"),
    )
