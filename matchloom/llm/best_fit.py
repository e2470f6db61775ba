"""Best-fit packing with dominance reduction (operator 5).

Pieces of equal length are interchangeable, so the packing problem of any
corpus is a histogram of at most ``capacity`` counts. The driver solves that
bounded problem once and gets runs of slots; the tasks that cut the documents
number their pieces of each length, counts by (length, task) make that a rank
among all, and the executors look the ranks' slots up. Nothing but the histogram
(bounded by the capacity) and the plan of runs reaches the driver.

Solving: dominance reduction after Martello and Toth fixes document sets that
provably dominate every alternative (see ``reduce_dominated``), then best fit
in order of falling length places the remainder.

Defined results: a null text is the empty text, which is one piece holding the
end token; an empty table gives no rows; repeated rows (equal doc_id and text)
are documents of their own; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .tokens import default_path, encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document, cut only where longer than ``capacity``; part and nth number the pieces of each length in a task."""
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        tail = np.array([end_id], np.uint32)
        part_id, given = TaskContext.get().partitionId(), [0] * (capacity + 1)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in slices(texts):
                ids, at = enc.encode(texts.slice(lo, hi - lo))
                out: list[tuple[int | None, ...]] = []
                for k in range(hi - lo):
                    own = np.concatenate([ids[at[k]:at[k + 1]], tail])
                    for n, s in enumerate(range(0, len(own), capacity)):
                        part = own[s:s + capacity]
                        out.append((doc_ids[lo + k], n, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), part_id, given[len(part)]))
                        given[len(part)] += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return id_and_text(docs).mapInArrow(cut, PIECES + ", part int, nth long")


class Runs:
    """Slots handed out in runs: ``count`` sequences from ``sequence`` on hold one piece of ``length`` each at ``offset``."""

    def __init__(self, counts: np.ndarray):
        self.left = {int(n): int(c) for n, c in enumerate(counts) if c}
        self.given: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, sequence, offset
        self.sequences = 0

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.given.get(length, 0)
        self.rows.append((length, rank, count, sequence, offset))
        self.given[length] = rank + count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def close(self, lengths: tuple[int, ...], count: int) -> None:
        """``count`` sequences that hold just these lengths."""
        offset = 0
        for n in lengths:
            self.take(n, count, self.sequences, offset)
            offset += n
        self.sequences += count


def reduce_dominated(runs: Runs, capacity: int) -> int:
    """Fix dominating sets, longest piece first; returns the sequences fixed.

    With ``w`` the longest piece left and ``x`` the longest other that fits
    beside it, a set dominates all alternatives if any bin that could hold
    ``w`` can be exchanged for it without needing more bins:

    * nothing fits beside ``w``: {w};
    * ``x`` fills the sequence exactly: {w, x};
    * no two of the pieces left fit beside ``w`` together: {w, x};
    * two fit at most, and ``x`` is as long as any two that fit: {w, x}.

    A case found for a length holds for all its equal pieces at once, as long
    as those it is joined with last; the loop ends at the first length to which
    none applies and looks at shorter ones only for exact partners, which stay
    dominating whatever else is left.
    """
    fixed = 0
    done = capacity + 1
    order = sorted(runs.left)
    while order:
        pos = bisect_left(order, done) - 1
        if pos < 0:
            break
        w = done = order[pos]
        if w not in runs.left:
            continue
        room = capacity - w
        longest = all(n <= w for n in runs.left)
        rest = sorted(n for n in runs.left if n != w or runs.left[n] > 1)
        at = bisect_left(rest, room + 1) - 1
        if at < 0:
            if longest or room < min(runs.left):
                count = runs.left[w]
                runs.close((w,), count)
                fixed += count
            continue
        x = rest[at]
        two = [n for n in rest for _ in range(min(2, runs.left[n] - (n == w)))][:2]
        only_one = len(two) < 2 or sum(two) > room
        dominating = x == room or (longest and (only_one or _longest_pair(rest, runs, w, room) <= x and not _three_fit(rest, runs, w, room)))
        # Fewer pieces leave fewer alternatives, so the case holds for all equal pieces at once.
        count = (runs.left[w] // 2 if x == w else min(runs.left[w], runs.left[x])) if dominating else 0
        if count:
            runs.close((w, x), count)
            fixed += count
            if w in runs.left:
                done = w + 1  # the same length again, with another partner
    return fixed


def _longest_pair(rest: list[int], runs: Runs, w: int, room: int) -> int:
    """The most that two pieces beside ``w`` can fill (0: no two fit)."""
    best, lo, hi = 0, 0, len(rest) - 1
    while lo <= hi:
        total = rest[lo] + rest[hi]
        if total > room:
            hi -= 1
            continue
        if lo < hi or runs.left[rest[lo]] - (rest[lo] == w) > 1:
            best = max(best, total)
        lo += 1
    return best


def _three_fit(rest: list[int], runs: Runs, w: int, room: int) -> bool:
    smallest = [n for n in rest for _ in range(min(3, runs.left[n] - (n == w)))][:3]
    return len(smallest) == 3 and sum(smallest) <= room


def best_fit(runs: Runs, capacity: int) -> None:
    """Best fit by falling length. Open sequences of equal room are kept as runs, so equal pieces move together."""
    rooms: list[int] = []  # sorted
    open_at: dict[int, list[tuple[int, int]]] = {}  # room -> runs (sequence, count), lowest first

    def put(room: int, sequence: int, count: int) -> None:
        if room:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            heapq.heappush(open_at[room], (sequence, count))

    for n in sorted(runs.left, reverse=True):
        while n in runs.left:
            need = runs.left[n]
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                sequence, count = heapq.heappop(open_at[room])
                used = min(count, need)
                if used < count:
                    heapq.heappush(open_at[room], (sequence + used, count - used))
                elif not open_at[room]:
                    del open_at[room], rooms[at]
                runs.take(n, used, sequence, capacity - room)
                put(room - n, sequence, used)
            else:
                each = capacity // n
                full, over = divmod(need, each)
                for count, held in ((full, each), (1 if over else 0, over)):
                    if count:
                        first = runs.sequences
                        runs.sequences += count
                        for k in range(held):
                            runs.take(n, count, first, k * n)
                        put(capacity - held * n, first, count)


def plan(counts: np.ndarray, capacity: int) -> Runs:
    """Solve a histogram of piece lengths (index: length)."""
    runs = Runs(counts)
    reduce_dominated(runs, capacity)
    best_fit(runs, capacity)
    return runs


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[row["length"]] = row["n"]
    runs = plan(counts, capacity)
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in runs.rows:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    table = {n: np.array(v, np.int64).T for n, v in by_length.items()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                ranks, sequences, offsets = table[int(n)]
                run = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own] = sequences[run] + rank[own] - ranks[run]
                offset[own] = offsets[run]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece."""
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id)), capacity)
