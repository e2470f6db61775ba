"""The 26 features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.strings import STRING_FEATURES, string_scores

from .blocking import ADDR_COSINE_KEYS, NAME_KEYS, Keep, idf, union_keys

# The features in model order.
FEATURES = [
    "name_tfidf", "addr_tfidf", "name_ratio", "name_token_set", "name_partial", "core_ratio", "core_token_set", "core_jaro_winkler", "core_token_jaccard",
    "first_token_match", "acronym_match", "legal_form_match", "name_len_diff", "addr_token_set", "addr_partial", "addr_token_jaccard", "postcode_match",
    "number_jaccard", "same_country", "is_source3", "name_rank", "addr_rank", "name_gap", "addr_gap", "n_candidates", "reverse_rank",
]
COSINES = {"name_tfidf": NAME_KEYS, "addr_tfidf": ADDR_COSINE_KEYS}
DECIMALS = 6


def _vectors(keyed: DataFrame, channels: dict[str, list[str]], n: int, keep: Keep) -> DataFrame:
    """(id, and for each channel: map of a record's tokens to their idf, norm), all channels in one pass."""
    parts = F.array(*[F.struct(F.lit(k).alias("c"), union_keys(kinds).alias("tokens")) for k, kinds in enumerate(channels.values())])
    rows = keyed.select(F.col("entity_id").alias("id"), F.explode(parts).alias("p")).select("id", "p.c", F.explode("p.tokens").alias("token"))
    # Kept before the join, like the weights of blocking: a frequent token's rows can then be split.
    df = keep(rows.groupBy("c", "token").agg(F.count(F.lit(1)).alias("df")))
    own = rows.join(df, ["c", "token"]).withColumn("v", idf(n)).groupBy("id")
    out = []
    for k, name in enumerate(channels):
        mine = F.col("c") == k
        out += [F.map_from_entries(F.collect_list(F.when(mine, F.struct("token", "v")))).alias(f"{name}_idf"), F.sqrt(F.sum(F.when(mine, F.col("v") * F.col("v")))).alias(f"{name}_norm")]
    return own.agg(*out)


def cosines(pairs: DataFrame, keyed: DataFrame, keep: Keep = DataFrame.persist) -> DataFrame:
    """``pairs`` with the full cosines on name and on address keys, 0 without a shared key."""
    v = keep(_vectors(keyed, COSINES, keyed.count(), keep))  # joined twice
    a, b = (v.select(F.col("id").alias(k), F.struct(*[c for c in v.columns if c != "id"]).alias(f"{k}_v")) for k in "ij")
    joined = pairs.join(a, "i", "left").join(b, "j", "left")
    for name in COSINES:
        left, right = (F.col(f"{k}_v.{name}_idf") for k in "ij")
        shared = F.array_intersect(F.map_keys(left), F.map_keys(right))
        dot = F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + F.pow(F.element_at(left, t), 2.0))  # noqa: B023
        value = F.round(dot / F.col(f"i_v.{name}_norm") / F.col(f"j_v.{name}_norm"), DECIMALS)
        joined = joined.withColumn(name, F.coalesce(value, F.lit(0.0)))
    return joined.select(*pairs.columns, *COSINES)


def context(pairs: DataFrame) -> DataFrame:
    """Ranks, gaps and list sizes within each reference record's list and among each pool record's rivals."""
    mine, rivals = Window.partitionBy("i"), Window.partitionBy("j")
    both = F.round(F.col("name_tfidf") + F.col("addr_tfidf"), DECIMALS)
    return pairs.withColumns({
        "name_rank": F.rank().over(mine.orderBy(F.desc("name_tfidf"))),
        "addr_rank": F.rank().over(mine.orderBy(F.desc("addr_tfidf"))),
        "name_gap": F.round(F.max("name_tfidf").over(mine) - F.col("name_tfidf"), DECIMALS),
        "addr_gap": F.round(F.max("addr_tfidf").over(mine) - F.col("addr_tfidf"), DECIMALS),
        "n_candidates": F.count(F.lit(1)).over(mine),
        "reverse_rank": F.rank().over(rivals.orderBy(both.desc())),
    })


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; null for two empty sets."""
    inter = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - inter
    return F.when(total > 0, inter / total)


def tri_state(a: Column, b: Column) -> Column:
    """1 if the sets share a member, 0 if not, null if a side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b).cast("double"))


_RECORD = ["name_norm", "name_core", "addr_norm", "country_norm", "core", "acronym", "addr", "postcode", "number", "legal", "first"]


def gather(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """``pairs`` with both records as structs a and b."""
    record = F.struct(*_RECORD)
    left = keyed.where("is_ref").select(F.col("entity_id").alias("i"), record.alias("a"))
    right = keyed.where("not is_ref").select(F.col("entity_id").alias("j"), record.alias("b"))
    return pairs.join(left, "i").join(right, "j")


def set_features(gathered: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    la, lb = F.char_length(a["name_core"]), F.char_length(b["name_core"])
    acronym = F.arrays_overlap(a["acronym"], b["core"]) | F.arrays_overlap(b["acronym"], a["core"])
    return gathered.withColumns({
        "core_token_jaccard": jaccard(a["core"], b["core"]), "first_token_match": F.coalesce((a["first"] == b["first"]).cast("double"), F.lit(0.0)),
        "acronym_match": F.coalesce(acronym, F.lit(False)).cast("double"), "legal_form_match": tri_state(a["legal"], b["legal"]),
        "name_len_diff": F.abs(la - lb) / F.greatest(la, lb, F.lit(1)), "addr_token_jaccard": jaccard(a["addr"], b["addr"]),
        "postcode_match": tri_state(a["postcode"], b["postcode"]), "number_jaccard": jaccard(a["number"], b["number"]),
        "same_country": (a["country_norm"] == b["country_norm"]).cast("double"), "is_source3": F.col("j").startswith("S3-").cast("double"),
    })


def string_features(gathered: DataFrame) -> DataFrame:
    scored = gathered.withColumn("scores", string_scores(F.col("a"), F.col("b")))
    return scored.withColumns({name: F.col("scores")[name] for name, *_ in STRING_FEATURES}).drop("scores")


def pair_features(pairs: DataFrame, keyed: DataFrame, only: DataFrame | None = None, keep: Keep = DataFrame.persist) -> DataFrame:
    """All 26 features. Context covers all pairs; ``only`` (entity_id) limits the costly rest to some reference records."""
    pairs = context(cosines(pairs, keyed, keep))
    if only is not None:
        pairs = pairs.join(only.select(F.col("entity_id").alias("i")), "i", "left_semi")
    return string_features(set_features(gather(pairs, keyed))).select("i", "j", *[F.col(f).cast("double").alias(f) for f in FEATURES])
