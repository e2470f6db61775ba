"""Exact top-k by columnar branch and bound (operator 1).

Vectors are quantised to integers, floor(scale * x), and scored by integer
inner product. Queries and candidates are laid out in blocks; a task meets one
block of each. Inside it the candidates stand in vertical layout (a row for
each dimension) and scores accumulate one block of dimensions after another.
After each, what the remaining dimensions can still add to a candidate is at
most the product of the remaining norms of query and candidate; a candidate
whose sum plus that bound lies below the query's k-th best complete score so
far is out, and the survivors are compacted before the next block. Each task
answers with its k best for each query, and these are merged.

Scores are exact: sums of integers stay below 2^53 in double arithmetic, and
where norms are too large for that, the task computes in Python integers and
clamps to the range of a long.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; missing trailing components count as 0; rows sharing an id are
one item, whose score against a query is the best of its rows', and a query
that repeats takes its best as well; an item is never its own candidate; null
ids take no part; ties go to the smaller id; fewer than k candidates give all;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
#: Rows of a block of candidates, and of queries.
CANDIDATES, QUERIES = 8192, 2048
#: Candidate blocks that share a column of the grid.
COLUMN = 4
#: Dimensions that are accumulated between two prunings.
DIMENSIONS = 16
_LONG = 2**63 - 1


def quantise(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """Rows of floor(scale * x), zero-padded to the longest."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), max(1, width)))
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = np.floor(scale * np.asarray(v, np.float64))
    return out


def _rows(packed: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(packed, kind).reshape(n, -1).astype(np.float64)


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K, step: int = DIMENSIONS) -> Iterator[tuple[int, int, int]]:
    """(query id, candidate id, score) of the best k distinct candidates of each query row in this block."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    biggest = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * width
    if not biggest < 2**52:
        yield from _plain(queries, query_ids, rows, ids, k)
        return
    order = np.argsort(-(rows**2).sum(0), kind="stable")  # heavy dimensions first: the bound shrinks soonest
    columns = np.ascontiguousarray(rows[:, order].T)
    queries = queries[:, order]
    edges = list(range(0, width, step)) + [width]
    rest = [np.sqrt((columns[e:] ** 2).sum(0)) for e in edges[1:]]
    rest_q = [np.sqrt((queries[:, e:] ** 2).sum(1)) for e in edges[1:]]
    first = queries[:, :edges[1]] @ columns[:edges[1]]
    spread = min(len(ids), max(4 * k, 256))
    for q in range(len(queries)):
        own = query_ids[q]
        # The most promising candidates, completed, give the first bar.
        head = np.argpartition(-(first[q] + rest_q[0][q] * rest[0]), spread - 1)[:spread] if spread < len(ids) else np.arange(len(ids))
        head = head[ids[head] != own]
        full = queries[q] @ columns[:, head]
        bar = _kth(full, ids[head], k)
        alive, sums = np.flatnonzero((first[q] + rest_q[0][q] * rest[0] >= bar - 0.5) & (ids != own)), None
        sums = first[q, alive]
        for b in range(1, len(edges) - 1):
            sums = sums + queries[q, edges[b]:edges[b + 1]] @ columns[edges[b]:edges[b + 1], alive]
            keep = sums + rest_q[b][q] * rest[b][alive] * (1 + 1e-9) >= bar - 0.5
            alive, sums = alive[keep], sums[keep]
        yield from _best(own, ids[alive], sums, k)


def _kth(scores: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The k-th best score of distinct ids, minus infinity where there are fewer."""
    order = np.lexsort((ids, -scores))
    _, place = np.unique(ids[order], return_index=True)
    best = np.sort(scores[order][place])[::-1]
    return best[k - 1] if len(best) >= k else -np.inf


def _best(own: int, ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    seen: set[int] = set()
    for i in np.lexsort((ids, -scores)):
        if int(ids[i]) not in seen:
            seen.add(int(ids[i]))
            yield int(own), int(ids[i]), int(scores[i])
            if len(seen) == k:
                return


def _plain(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """Values too large for exact doubles: Python integers, all candidates."""
    whole = [[int(x) for x in r] for r in rows]
    for own, q in zip(query_ids, queries, strict=True):
        q = [int(x) for x in q]
        found: dict[int, int] = {}
        for i, r in zip(ids, whole, strict=True):
            if i != own:
                s = max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, r, strict=True))))
                found[int(i)] = max(found.get(int(i), s), s)
        for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]:
            yield int(own), i, s


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks (block, n, ids, kind, rows) of at most ``size`` quantised vectors each, made where the rows are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            matrix = quantise(vectors, scale)
            largest = np.abs(matrix).max(initial=0)
            kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"
            return pa.RecordBatch.from_pydict({"block": [part << 32 | done], "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "kind": [kind], "rows": [matrix.astype(kind).tobytes()]})

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                ids.append(i)
                vectors.append(np.asarray(v.values))
                if len(ids) == size:
                    yield block()
                    ids, vectors, done = [], [], done + 1
        if ids:
            yield block()

    return materialize(rows.mapInArrow(pack, "block long, n int, ids binary, kind string, rows binary"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def search(vectors: DataFrame, is_query, k: int = K, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for every row for which ``is_query`` (a column of vec_id) holds."""
    rows = materialize(usable(vectors, id_col, vector_col))
    right = _blocks(rows, candidates, scale)
    left = _blocks(rows.where(is_query), queries, scale)
    n_left, n_right = left.count(), right.count()
    if not n_left:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The stated query set against all rows, in blocks, on a grid: a cell brings about one block of queries and COLUMN blocks
    # of candidates together, so no key holds more, and each block goes through one shuffle, once for each cell of its row or column.
    n_columns = -(-n_right // COLUMN)
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows_of = left.select(number(n_left).alias("row"), every(n_columns).alias("column"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("kind").alias("qkind"), F.col("rows").alias("qrows"))
    columns_of = right.select(every(n_left).alias("row"), number(n_columns).alias("column"), "n", "ids", "kind", "rows")
    width = max(1, min(n_left * n_columns, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    spread = columns_of.repartition(width, "row", "column").join(rows_of.repartition(width, "row", "column"), ["row", "column"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                found = block_top_k(_rows(t["qrows"], t["qkind"], t["qn"]), np.frombuffer(t["qids"], "<i8"), _rows(t["rows"], t["kind"], t["n"]), np.frombuffer(t["ids"], "<i8"), k)
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    best = spread.mapInArrow(run, "query_id long, vec_id long, score long")
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
