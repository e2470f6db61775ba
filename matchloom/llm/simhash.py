"""SimHash near-duplicates by tiled exact comparison (operator 6).

Fingerprints within ``radius`` bits agree in at least one of every
``blocks``-part split's (blocks - radius)-part selections, so fingerprints are
laid out in cells of equal selected bits. Inside a cell, rows ordered by
population count are compared tile against tile with exclusive-or and bit
counts; tile pairs whose counts differ beyond the radius are skipped. A cell
larger than ``TILE_ROWS`` is split into sub-blocks, and every pair of
sub-blocks is a task of its own. The selection gets finer as the table grows,
so cells stay small; the result is exact for every choice.

A cell answers with links to the smallest member of each group that it joins,
never with all pairs; links between distinct fingerprints then make connected
components. Equal fingerprints are merged before and expanded after by a join.

Defined results: a null or empty text has fingerprint zero, linked like any
other; repeated rows share their class; an empty table gives no rows; ties of
bits (exactly half) are 0; extra columns are ignored. A null doc_id counts as
larger than any other. A class is represented by one row, whatever other
classes hold rows of the same doc_id: that of the smallest doc_id, between rows
that share it that of the smallest text digest; rows of one doc_id and text
stay once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, text_column
from .components import components
from .tokens import slices

RADIUS = 3
#: Rows of a cell that are compared in one task; larger cells are split into sub-blocks of about this size.
TILE_ROWS = 2048
#: Rows on a side of one numpy tile.
TILE = 512
SHINGLE = 3


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = 42) -> bytes:
    """Eight bytes, most significant first."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and white space 0x20 and 0x09-0x0D
    if not words:
        return bytes(8)
    shingles = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k:k + 4096], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE, marked: bool = False) -> DataFrame:
    """(doc_id, fp long) of every whole text; with ``marked``, also mark, a digest of the text."""
    names = ["doc_id", *["mark"] * marked, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lo, hi in slices(texts):
                fps = b"".join([fingerprint(t.as_py(), size) for t in texts.slice(lo, hi - lo)])
                own = [batch.column(c).slice(lo, hi - lo) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=names)

    rows = id_and_text(docs)
    return (rows.withColumn("mark", F.unhex(F.md5("text"))) if marked else rows).mapInArrow(run, "doc_id long, mark binary, fp long" if marked else "doc_id long, fp long")


def selections(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two values within the radius agree under one of them; about 256 rows a cell at most if values were random."""
    blocks = radius + 1
    while blocks < 12 and n / 2 ** (64 * (blocks - radius) / blocks) > 256:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(kept) for kept in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tiles(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs between two lists of rows, each ordered by population count."""
    counts = np.bitwise_count(fps.view(np.uint64)).astype(np.int64)
    left, right = left[np.argsort(counts[left], kind="stable")], right[np.argsort(counts[right], kind="stable")]
    for a in range(0, len(left), TILE):
        x = left[a:a + TILE]
        for b in range(0, len(right), TILE):
            y = right[b:b + TILE]
            if counts[y[0]] - counts[x[-1]] > radius or counts[x[0]] - counts[y[-1]] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(fps[x][:, None].view(np.uint64) ^ fps[y][None, :].view(np.uint64)) <= radius)
            i, j = x[i], y[j]
            yield i[i != j], j[i != j]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of each pair in place; a label is the group's smallest index."""
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (next_ := label[label] != label).any():
            label[next_] = label[label[next_]]
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]


def cell_links(cell: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links to the first linked member of each group. ``cell``: run ids in order; ``side``: 0 or 1 (2: compared with all)."""
    label = np.arange(len(fps))
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, int(sizes[sizes <= 32].max(initial=0))):  # small cells, all at once
        i = np.flatnonzero(small[:-d] & (cell[d:] == cell[:-d]))
        i = i[np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= radius]
        _join(label, i, i + d)
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        own, part = np.arange(s, s + n), side[s:s + n]
        first, second = (own, own) if part[0] == 2 else (own[part == 0], own[part == 1])
        for i, j in _tiles(fps, first, second, radius):
            _join(label, i, j)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b) fingerprint links that connect what is within the radius. ``distinct``: a written table with fp."""
    spark = distinct.sparkSession
    masks = selections(distinct.count(), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = materialize(keyed.groupBy("t", "key").count().where("count > 1"))
    n_blocks = F.ceil(F.col("count") / F.lit(tile_rows)).cast("int")
    placed = keyed.join(sizes, ["t", "key"]).select("t", "key", "fp", n_blocks.alias("n")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = spread.select(
        F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "t", "key",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    order = ["cell", "t", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, order):
            key = np.stack([rows.column(c).to_numpy() for c in order])
            cell = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
            a, b = cell_links(cell, rows.column("side").to_numpy(), rows.column("fp").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(width, "cell").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def whole_runs(batches: Iterator[pa.RecordBatch], order: list[str], at_least: int = 65536) -> Iterator[pa.Table]:
    """Tables of complete runs of equal ``order`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= at_least:
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in order]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(order, last, strict=True):
                same &= table.column(c).to_numpy() == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _classed(distinct: DataFrame, radius: int) -> DataFrame:
    """The rows of ``distinct`` (a written table with fp) with root, which is the same for all fingerprints of a class."""
    roots = materialize(components(materialize(links(distinct, radius))))
    return materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    own = materialize(fingerprints(docs, size))
    classed = _classed(materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"))), radius)
    least = materialize(classed.groupBy("root").agg(F.min("first").alias("component_id")))
    of_fp = materialize(classed.join(least, "root").select("fp", "component_id"))
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, null last."""
    own = fingerprints(docs, size, marked=True)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    classed = _classed(materialize(own.groupBy("fp").agg(F.min(row).alias("first"))), radius)
    kept = classed.groupBy("root").agg(F.min("first").alias("best")).select(F.col("best.none").alias("_none"), F.col("best.id").alias("_id"), F.col("best.mark").alias("_mark"))
    key = ["_none", "_id", "_mark"]  # no nulls: one shuffle of the rows serves the join and what follows
    rows = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_mark": F.unhex(F.md5(text_column()))})
    return rows.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
