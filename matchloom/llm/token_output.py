"""Packed token-id output (operator 4): best-fit decreasing with a segment tree.

Each input partition is packed in windows of a bounded number of tokens: the
documents of a window are cut into pieces of at most ``capacity`` tokens
(lossless: piece k+1 goes on where piece k ends) and placed by best-fit
decreasing; a segment tree over room sizes finds the tightest open sequence.
There is no shuffle, a task holds one window, and a lost task is redone from
its own input split alone.

One row per packed sequence: the padded id row of the matrix, cumulative
segment lengths (0 first), positions that restart at every segment, and the
documents and pieces that the segments hold.

Defined results: a null text is the empty text (one piece with the end id
only); an empty table gives no rows; repeated rows are documents of their own;
ties of room go to the sequence opened first; a null doc_id stays null; extra
columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text
from .tokens import default_path, encoder, slices

#: Tokens that one packing window gathers.
WINDOW_TOKENS = 4 << 20
PACKED = "window_id string, sequence int, n_tokens int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


class RoomTree:
    """Segment tree over room sizes 0..capacity: counts of open sequences; finds the least room >= n."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, deque[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, deque()).append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the tightest fit."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour holds something
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].popleft()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each sequence."""
    tree, bins = RoomTree(capacity), []
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        room, b = tree.take(n) or (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(int(k))
        if room > n:
            tree.put(room - n, b)
    return bins


def _sequences(docs: list[tuple[int | None, np.ndarray]], name: str, capacity: int, pad_id: int) -> pa.RecordBatch:
    parts = [(doc, n, s, ids[s:s + capacity]) for doc, ids in docs for n, s in enumerate(range(0, len(ids), capacity))]
    bins = best_fit_decreasing(np.array([len(p[3]) for p in parts]), capacity)
    matrix = np.full((len(bins), capacity), pad_id, np.int32)
    positions = np.zeros((len(bins), capacity), np.int32)
    cumulative, owner, piece, start, total = [], [], [], [], []
    for row, own in enumerate(bins):
        at, ends = 0, [0]
        for k in own:
            n = len(parts[k][3])
            matrix[row, at:at + n] = parts[k][3]
            positions[row, at:at + n] = np.arange(n)
            at += n
            ends.append(at)
        cumulative.append(ends)
        owner.append([parts[k][0] for k in own])
        piece.append([parts[k][1] for k in own])
        start.append([parts[k][2] for k in own])
        total.append(at)
    rows = pa.array(np.arange(0, matrix.size + 1, capacity, dtype=np.int32))
    ids, pos = (pa.ListArray.from_arrays(rows, pa.array(x.ravel())) for x in (matrix, positions))
    lists = [pa.array(cumulative, pa.list_(pa.int32())), pos, pa.array(owner, pa.list_(pa.int64())), pa.array(piece, pa.list_(pa.int32())), pa.array(start, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(bins)), pa.array(range(len(bins)), pa.int32()), pa.array(total, pa.int32()), ids, *lists],
        names=["window_id", "sequence", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"],
    )


def packed_sequences(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1, pad_id: int = 0, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed sequence of every document's ids; window_id names the task and its window."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, tail, part = encoder(path), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = done = 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in slices(texts):
                ids, at = enc.encode(texts.slice(lo, hi - lo))
                for k in range(hi - lo):
                    held.append((doc_ids[lo + k], np.concatenate([ids[at[k]:at[k + 1]], tail])))
                size += len(ids) + hi - lo
                if size >= window_tokens:
                    yield from _emit(_sequences(held, f"{part:06d}-{done:06d}", capacity, pad_id))
                    held, size, done = [], 0, done + 1
        if held:
            yield from _emit(_sequences(held, f"{part:06d}-{done:06d}", capacity, pad_id))

    return id_and_text(docs).mapInArrow(run, PACKED)


def _emit(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


MATRICES = "window_id string, n_sequences int, input_ids binary, position_ids binary, n_segments binary, cu_seqlens binary, doc_ids array<long>, pieces array<int>, starts array<long>"


def packed_matrices(packed: DataFrame, rows: int = 64) -> DataFrame:
    """Matrices of up to ``rows`` packed sequences as little-endian bytes.

    input_ids (u4) and position_ids (i4) are row by row; n_segments (i4) counts
    each row's segments, and cu_seqlens (i4) strings the rows' cumulative lengths
    together, each from 0 on and so one longer than the row's segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def raw(column: pa.Array, kind: str) -> pa.Array:
            return pa.array([np.asarray(column).astype(kind).tobytes()], pa.binary())

        for batch in batches:
            names = batch.column("window_id").to_pylist()
            cuts = sorted({0, len(names), *range(0, len(names), rows), *(k for k in range(1, len(names)) if names[k] != names[k - 1])})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                sizes = pc.subtract(pc.list_value_length(part.column("cu_seqlens")), 1)
                lists = [pa.array([part.column(c).flatten().to_pylist()], t) for c, t in (("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[lo]]), pa.array([hi - lo], pa.int32()), raw(part.column("input_ids").flatten(), "<u4"), raw(part.column("position_ids").flatten(), "<i4"),
                     raw(sizes, "<i4"), raw(part.column("cu_seqlens").flatten(), "<i4"), *lists],
                    names=[f.split()[0] for f in MATRICES.split(", ")],
                )

    return packed.mapInArrow(run, MATRICES)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed id matrices with their segment lengths and positions, in binary."""
    packed_matrices(packed_sequences(docs, **options)).write.mode("overwrite").parquet(path)


def read_back(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, start, ids) of every segment: the inverse, for checks and readers."""
    from pyspark.sql import functions as F

    segment = F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("k", "s")
    return packed.select(segment, "input_ids", "cu_seqlens").select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"),
        F.slice("input_ids", F.element_at("cu_seqlens", F.col("k") + 1) + 1, F.element_at("cu_seqlens", F.col("k") + 2) - F.element_at("cu_seqlens", F.col("k") + 1)).alias("ids"),
    )
