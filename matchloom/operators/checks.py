"""Integrity rules of the two output lists, as one table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _issue(df: DataFrame, rule: str, file: str, example: str = "''") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(file).alias("file"), "s1_id", F.expr(example).alias("example"))


def parsed(cell: str = "cell"):
    """Ids of a comma list, empty items dropped."""
    return F.filter(F.split(F.coalesce(F.col(cell), F.lit("")), ","), lambda x: x != "")


def list_issues(lists: DataFrame, s1: DataFrame, pool: DataFrame, file: str) -> DataFrame:
    """Issues of one file's rows (s1_id, cell): repeated, missing and unknown reference ids; repeated and unknown listed ids."""
    known, members = s1.select(F.col("entity_id").alias("s1_id")), pool.select(F.col("entity_id").alias("id"))
    ids = lists.select("s1_id", parsed().alias("ids"))
    listed = ids.select("s1_id", F.explode("ids").alias("id"))
    return reduce(DataFrame.union, [
        _issue(lists.groupBy("s1_id").count().where("count > 1"), "duplicate source1_entity_id", file),
        _issue(known.join(lists, "s1_id", "left_anti"), "missing source1_entity_id", file),
        _issue(lists.select("s1_id").distinct().join(known, "s1_id", "left_anti"), "unknown source1_entity_id", file),
        _issue(ids.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id").distinct(), "duplicate ids in list", file),
        _issue(listed.join(members, "id", "left_anti").groupBy("s1_id").agg(F.min("id").alias("id")), "ids not in pool", file, "id"),
    ])


def subset_issues(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reference records with matched ids that are no candidates of theirs."""
    pairs = [x.select("s1_id", F.explode(parsed()).alias("id")).distinct() for x in (matches, candidates)]
    outside = pairs[0].join(pairs[1], ["s1_id", "id"], "left_anti").groupBy("s1_id").agg(F.min("id").alias("id"))
    return _issue(outside, "matched ids missing from candidates", "candidate_pairs.tsv", "id")


def issues(matches: DataFrame, candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    found = [list_issues(matches, s1, pool, "matching_results.tsv"), list_issues(candidates, s1, pool, "candidate_pairs.tsv"), subset_issues(matches, candidates)]
    return reduce(DataFrame.union, found)
