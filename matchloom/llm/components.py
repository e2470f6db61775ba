"""Connected components of a link table, by alternating star contractions.

Each half-round connects the neighbours of a node to its smallest neighbour;
the number of edges never grows and the rounds are logarithmic in practice.
Every intermediate is a written table: both sides of each join are then plain
scans, whose shuffles adaptive execution can split where one node has very
many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node (a) to the smaller (b)."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return materialize(_oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(_oriented(moved.union(least.select("a", F.col("m").alias("b")))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, roots included; root is the smallest node reachable."""
    edges = materialize(_oriented(links.select(F.col(links.columns[0]).alias("a"), F.col(links.columns[1]).alias("b"))))
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
