"""Stupid-backoff scores by joins of n-gram count tables (operator 10).

With c the corpus counts less the document's own (a document is no evidence
for itself), N the corpus words less its own and alpha = 0.4,

    S(w | v) = c(v w) / c(v)           if c(v w) > 0
             = alpha * U(w)            otherwise, U(w) = max(c(w), 1/2) / max(N, 1)

and a document's score is the sum of ln S over its words, ln U for the first.

The relations travel as sorted columns, not as a row for every n-gram:

* exploded n-grams: each group of consecutive documents gives, for each hash
  range, its distinct n-grams and how often it holds them (``_asks``);
* count tables: the n-grams of a hash range from all groups are summed in one
  place, whichever groups they come from (``_answers``). A word in every
  document is one entry of each group, so no n-gram is a hot key;
* join: each group gets back the corpus counts of its own n-grams, and the
  logarithms are summed per document (``_scores``).

The count tables cover all documents and grow with the corpus. The empty
n-gram counts the words, so N comes by the same join.

Defined results: a null text is the empty text; no words give 0 words, a score
of 0.0 and a null mean; an empty table gives no rows; repeated rows count as
documents of their own, so they are evidence for each other; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .simhash import whole_runs

ALPHA = 0.4
ORDER = 3
#: Bytes of text in a group, and n-gram entries in a hash range (about).
GROUP_BYTES, RANGE_ENTRIES = 8 << 20, 1 << 21
#: Tasks that the hash ranges are dealt to; a task takes its ranges one after another.
MOST_TASKS = 1 << 16
CACHE_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DROP = np.uint64(8)  # 56 bits name an n-gram: sorted differences stay short
_known: dict[bytes, int] = {}


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text)."""
    import xxhash

    if len(_known) > CACHE_WORDS:
        _known.clear()
    out: list[int] = []
    ends = [0]
    for text in texts:
        words = text.lower().split()
        found = list(map(_known.get, words))
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    w = words[k]
                    found[k] = _known[w] = xxhash.xxh3_64_intdigest(w)
        out += found
        ends.append(len(out))
    return np.array(out, np.uint64), np.array(ends)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) >> _DROP


def longer(raw: np.ndarray, words: np.ndarray) -> np.ndarray:
    """From the n-grams that end at each place, those of one word more."""
    out = np.zeros_like(raw)
    out[1:] = raw[:-1] * np.uint64(31) + words[1:] * _MIX
    return out


EMPTY = np.uint64(0)


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T  # bytes of equal weight together
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(flat.T).view("<u8").ravel()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Groups of consecutive documents of a partition, numbered."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            ids.append(i)
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= GROUP_BYTES:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


class Level:
    """Distinct n-grams of a group's documents, how often it holds each, and how often the n-gram at each place stands in its document."""

    def __init__(self, values: np.ndarray, doc: np.ndarray):
        order = np.argsort(values, kind="stable")  # documents of equal n-grams stay in order
        v, d = values[order], doc[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])[:len(v)]
        runs = new | np.concatenate([[True], d[1:] != d[:-1]])[:len(v)]
        self.names = v[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(v)))
        self.index, self.own = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        self.index[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(runs)
        sizes = np.diff(np.append(starts, len(v)))
        self.own[order] = np.repeat(sizes, sizes)

    def others(self, totals: np.ndarray) -> np.ndarray:
        """Corpus counts less the document's own."""
        return totals[self.index].astype(np.int64) - self.own


class Group:
    """The words of consecutive documents, and their n-grams' counts in other documents, order by order."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.words, self.ends = words, ends
        sizes = np.diff(ends)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = np.arange(len(words)) - np.repeat(ends[:-1], sizes)  # words before it in its document
        self.counts: list[np.ndarray] = []
        self.raw = words

    def first(self) -> tuple[np.ndarray, np.ndarray, Level]:
        """Names and counts of the empty n-gram, words and pairs."""
        second = self.place > 0
        pairs = longer(self.words, self.words)
        level = Level(np.concatenate([_mixed(self.words), _mixed(pairs[second])]), np.concatenate([self.doc, self.doc[second]]))
        self.raw = pairs
        return np.concatenate([[EMPTY], level.names]), np.concatenate([[len(self.words)], level.counts]), level

    def learn_first(self, level: Level, totals: np.ndarray) -> None:
        self.total = int(totals[0])
        c, n = level.others(totals[1:]), len(self.words)
        pair = np.zeros(n, np.int64)
        pair[self.place > 0] = c[n:]
        self.counts = [c[:n], pair]

    def next(self) -> tuple[np.ndarray, Level]:
        """Where n-grams of one more word may occur elsewhere, and those n-grams."""
        m, last = len(self.counts) + 1, self.counts[-1]
        self.raw = longer(self.raw, self.words)
        at = self.place >= m - 1
        at[1:] &= (last[1:] > 0) & (last[:-1] > 0)
        at = np.flatnonzero(at)
        return at, Level(_mixed(self.raw[at]), self.doc[at])

    def learn_next(self, at: np.ndarray, level: Level, totals: np.ndarray) -> None:
        c = np.zeros(len(self.words), np.int64)
        c[at] = level.others(totals)
        self.counts.append(c)


def _range_edges(names: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(names, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(56 - bits))


def _texts(row: dict) -> list[bytes]:
    import zstandard

    data, at, texts = zstandard.ZstdDecompressor().decompress(row["z"]), 0, []
    for n in row["sizes"]:
        texts.append(data[at:at + n])
        at += n
    return texts


def _known_group(row: dict, bits: int, order: int) -> Group:
    """A group with all that the answers so far say: ``a2`` of words and pairs, ``a3`` on of longer n-grams."""
    group = Group(*word_hashes(_texts(row)))
    if not row.get("a2"):
        return group
    names, _, level = group.first()
    group.learn_first(level, _totals(row["a2"]))
    for m in range(3, order + 1):
        if f"a{m}" not in row:
            break
        group.learn_next(*group.next(), _totals(row[f"a{m}"]))
    return group


def _totals(answers: list[dict] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(_unpack(a["totals"]) for a in sorted(answers or (), key=lambda a: a["range"]))])


def _asks(bits: int, order: int):
    """Requests of words and pairs (order 2), or of the n-grams of ``order`` words that may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                group = _known_group(row, bits, order - 1)
                if order == 2:
                    names, counts, _ = group.first()
                elif group.counts:
                    level = group.next()[1]
                    names, counts = level.names, level.counts
                else:
                    continue
                del group
                edges = _range_edges(names, bits)
                for r in range(1 << bits):
                    part = slice(edges[r], edges[r + 1])
                    if part.start < part.stop:
                        own = names[part]
                        yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "group": [row["group"]], "names": [_pack(np.diff(own, prepend=np.uint64(0)))], "counts": [_pack(counts[part])]})

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, ["range"], 1):
        ranges = table.column("range").to_numpy()
        for r in np.unique(ranges):
            rows = table.filter(pa.array(ranges == r)).to_pylist()
            names = [np.cumsum(_unpack(x["names"]), dtype=np.uint64) for x in rows]
            counts = np.concatenate([_unpack(x["counts"]) for x in rows]).astype(np.float64)
            all_names, place = np.unique(np.concatenate(names), return_inverse=True)
            total = np.bincount(place, counts, len(all_names)).astype(np.uint64)
            at = 0
            for x, own in zip(rows, names, strict=True):
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "group": [x["group"]], "totals": [_pack(total[place[at:at + len(own)]])]})
                at += len(own)


def log_scores(group: Group, alpha: float = ALPHA) -> np.ndarray:
    """Sum of ln S of each document of a group whose counts are known."""
    n_docs = len(group.ends) - 1
    if not len(group.words):
        return np.zeros(n_docs)
    others = np.maximum(group.total - np.diff(group.ends)[group.doc], 1.0)
    value = np.log(np.maximum(group.counts[0], 0.5) / others)
    for m in range(2, len(group.counts) + 1):
        count, history = group.counts[m - 1], np.empty_like(group.counts[0])
        history[0], history[1:] = 0, group.counts[m - 2][:-1]
        seen = (count > 0) & (history > 0)
        backed = np.where(group.place >= m - 1, np.log(alpha) + value, value)
        value = np.where(seen, np.log(np.maximum(count, 1)) - np.log(np.maximum(history, 1)), backed)
    return np.bincount(group.doc, value, n_docs)


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for group, ids, texts in _groups(batches):
        yield pa.RecordBatch.from_pydict({"group": [group], "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), "z": [press.compress(b"".join(texts))]})


def _scores(bits: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                group = _known_group(row, bits, order)
                score, n = log_scores(group), np.diff(group.ends)
                mean = [s / k if k else None for s, k in zip(score.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(score), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log"])

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log) of every whole text under the other documents' counts of up to ``order`` words."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    texts = id_and_text(docs)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = int(size // 4 // RANGE_ENTRIES).bit_length()
    # Written once: all uses below must see the same groups.
    payload = materialize(texts.mapInArrow(_payload, "group long, ids array<long>, sizes array<int>, z binary"))
    known = payload
    for m in range(2, order + 1):
        asked = known.drop("ids").mapInArrow(_asks(bits, m), "range int, group long, names binary, counts binary")
        answered = asked.repartition(min(1 << bits, MOST_TASKS), "range").sortWithinPartitions("range", "group").mapInArrow(_answers, "range int, group long, totals binary")
        by_group = materialize(answered).groupBy("group").agg(F.collect_list(F.struct("range", "totals")).alias(f"a{m}"))  # of one bounded group
        known = known.join(by_group, "group", "left")
    return known.mapInArrow(_scores(bits, order), "doc_id long, n_words long, log_score double, mean_log double")
