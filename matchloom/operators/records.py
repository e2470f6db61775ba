"""Normalised records and their key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as T

KINDS = ["core", "core_bi", "acronym", "addr", "addr_bi", "geo", "postcode", "number", "legal"]


def stack(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Reference records and pool records in one table (``is_ref`` tells them apart)."""
    return s1.withColumn("is_ref", F.lit(True)).unionByName(pool.withColumn("is_ref", F.lit(False)), allowMissingColumns=True)


def prepare(records: DataFrame) -> DataFrame:
    """Normalised columns; raw name and address are dropped."""
    name, address = F.col("business_name"), F.col("business_address")
    kept = [c for c in ("is_ref", "ord") if c in records.columns]
    norm = records.select("entity_id", *kept, "country", T.fold(F.col("country")).alias("country_norm"), T.normalize_name(name).alias("name_norm"),
                          T.normalize_address(address).alias("addr_norm"), T.postcodes(address).alias("postcodes"), T.numbers(address).alias("numbers"))
    return norm.withColumn("name_core", T.core_of(F.col("name_norm")))


def bigrams(words: Column) -> Column:
    """Adjacent word pairs of an ordered list."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.expr("cast(array() as array<string>)"))


def with_keys(records: DataFrame) -> DataFrame:
    """A set column for each kind of key, and the first core word (null without one)."""
    core, addr = T.tokens(F.col("name_core")), T.tokens(F.col("addr_norm"))
    initials = F.array_join(F.transform(core, lambda t: F.substring(t, 1, 1)), "")
    legal = F.array_intersect(T.tokens(F.col("name_norm")), F.array(*[F.lit(t) for t in T.LEGAL_TOKENS]))
    geo = F.flatten(F.transform("postcodes", lambda p: F.transform(core, lambda t: F.concat(F.lit("#"), p, F.lit(" "), F.substring(t, 1, 4)))))
    none = F.expr("cast(array() as array<string>)")
    return records.withColumns({
        "core": F.array_distinct(core), "core_bi": F.array_distinct(bigrams(core)), "acronym": F.when(F.char_length(initials) > 1, F.array(initials)).otherwise(none),
        "addr": F.array_distinct(addr), "addr_bi": F.array_distinct(bigrams(addr)), "geo": F.array_distinct(geo),
        "postcode": F.col("postcodes"), "number": F.col("numbers"), "legal": legal, "first": F.get(core, F.lit(0)),
    })


def key_rows(keyed: DataFrame) -> DataFrame:
    """One row for each record, kind and token."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens")) for k in KINDS])
    return keyed.select("entity_id", F.explode(parts).alias("p")).select("entity_id", "p.kind", F.explode("p.tokens").alias("token"))
