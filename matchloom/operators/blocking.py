"""Candidate pairs by pruned, IDF-weighted top-k similarity joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME_KEYS = ["core", "core_bi"]
ADDR_KEYS = ["addr", "addr_bi", "geo"]
ADDR_COSINE_KEYS = ["addr", "addr_bi"]


#: How operators keep a table that they read twice; a plan passes its own, which it can release.
Keep = Callable[[DataFrame], DataFrame]


def union_keys(kinds: list[str]) -> Column:
    out = F.col(kinds[0])
    for k in kinds[1:]:
        out = F.array_union(out, F.col(k))
    return out


def document_frequency(keyed: DataFrame, kinds: list[str]) -> DataFrame:
    """(token, df over all records, df_pool over the pool)."""
    rows = keyed.select("is_ref", F.explode(union_keys(kinds)).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.count_if(~F.col("is_ref")).alias("df_pool"))


def idf(n: int) -> Column:
    """Smooth inverse document frequency over ``n`` records, those without keys included."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1


def weights(keyed: DataFrame, kinds: list[str], keep: Keep = DataFrame.persist) -> DataFrame:
    """(id, is_ref, token, df_pool, w): weights of unit length over all of a record's keys.

    The table is used on both sides of the similarity join, so it is kept.
    """
    n = keyed.count()
    rows = keyed.select(F.col("entity_id").alias("id"), "is_ref", F.explode(union_keys(kinds)).alias("token"))
    # Kept before the join: a very frequent token's rows can then be split by adaptive execution.
    df = keep(document_frequency(keyed, kinds))
    weighted = rows.join(df, "token").withColumn("raw", idf(n))
    own = Window.partitionBy("id")
    return keep(weighted.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(own))).drop("raw", "df"))


def usable_keys(weighted: DataFrame, max_df: int, fallback_df: int) -> DataFrame:
    """Reference keys that block: those in 1 to ``max_df`` pool records, or, where a record has none, its rarest up to ``fallback_df``."""
    own = Window.partitionBy("id")
    seen = F.col("df_pool") >= 1
    left = weighted.where("is_ref").withColumns({
        "kept": seen & (F.col("df_pool") <= max_df),
        "rarest": F.min(F.when(seen, F.col("df_pool"))).over(own),
    }).withColumn("has_key", F.max("kept").over(own))
    fallback = ~F.col("has_key") & seen & (F.col("df_pool") == F.col("rarest")) & (F.col("df_pool") <= fallback_df)
    return left.where(F.col("kept") | fallback).select(F.col("id").alias("i"), "token", F.col("w").alias("wi"))


def similarity(weighted: DataFrame, max_df: int, fallback_df: int) -> DataFrame:
    """(i, j, sim) over shared usable keys: the right side of a key is bounded by the pruning, the left is split where skewed."""
    left = usable_keys(weighted, max_df, fallback_df)
    right = weighted.where("not is_ref").select(F.col("id").alias("j"), "token", F.col("w").alias("wj"))
    return left.join(right, "token").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("sim"))


def channel_top_k(keyed: DataFrame, kinds: list[str], k: int, max_df: int = 3000, fallback_df: int = 30000, keep: Keep = DataFrame.persist) -> DataFrame:
    """The k most similar pool records of each reference record; ties to the smaller id."""
    found = similarity(weights(keyed, kinds, keep), max_df, fallback_df)
    best = Window.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(k, 0))


def candidates(keyed: DataFrame, k_name: int = 15, k_addr: int = 10, max_df: int = 3000, fallback_df: int = 30000, keep: Keep = DataFrame.persist) -> DataFrame:
    """Distinct (i, j) of the name channel and the address channel."""
    name = channel_top_k(keyed, NAME_KEYS, k_name, max_df, fallback_df, keep)
    addr = channel_top_k(keyed, ADDR_KEYS, k_addr, max_df, fallback_df, keep)
    return name.select("i", "j").union(addr.select("i", "j")).distinct()


def as_lists(pairs: DataFrame, s1: DataFrame, name: str) -> DataFrame:
    """One row for each reference record, empty lists included; ids in order."""
    lists = pairs.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("js"))  # at most k ids a record
    ids = s1.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(lists, ids["source1_entity_id"] == lists["i"], "left").select("source1_entity_id", F.coalesce(F.array_join("js", ","), F.lit("")).alias(name))
