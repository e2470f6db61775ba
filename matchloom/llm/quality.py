"""Quality rules by a hashed n-gram log-likelihood ratio (operator 7).

Words and word pairs are hashed into a fixed number of buckets. Two smoothed
multinomials over the buckets - trusted target (every document labelled good)
and raw corpus (every document) - give each bucket a log-likelihood ratio; a
document's score is their mean over its n-grams. The threshold is one number
for all documents: where it best separates all labels while at most
``MAX_LOST`` of the good ones fall below. It is chosen on cross-fitted scores:
the documents are split in two by a hash of the id, and each half is scored by
ratios whose target is the other half's. Labels meet documents in joins; the
driver holds bucket counts and sums over bins of scores only.

Defined results: a null text is the empty text, whose counts are 0, whose base
rules fail and which is not kept; no labelled rows give ratios of 0 and keep
what passes the base rules; an empty table gives no rows; rows repeated in the
labels count once (the lower quality); rows of a null doc_id are judged, never
learnt from, and rows that share a labelled id all count for it; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .tokens import slices

BUCKET_BITS = 16
#: Share of the good documents that the threshold may lose.
MAX_LOST = 0.01
#: Bins of scores to one unit, and bins on either side of 0; the outermost hold all beyond.
BINS_UNIT, BINS_SIDE = 4096, 32768
CACHE_WORDS = 400_000
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def n_repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside ``width``-word windows that occur twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    key, span = ids, len(known)
    for k in range(1, width):
        key = key[:n + width - 1 - k] * span + ids[k:]  # ranks below len(words) times span: no overflow
        if k + 1 < width:
            key = np.unique(key, return_inverse=True)[1]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[place] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat_words(words),
    )


def base_failed(n_words: int, repeated: int) -> bool:
    return n_words < 10 or 100 * repeated > 20 * n_words


class Hasher:
    """Buckets of words and word pairs."""

    def __init__(self, bits: int = BUCKET_BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def buckets(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    w = words[k].lower()
                    found[k] = known[words[k]] = zlib.crc32(w) << 32 | zlib.crc32(w[::-1])
        h = np.array(found, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        pairs = (h[:-1] * np.uint64(31) + h[1:]) * _MIX
        return np.concatenate([h, pairs]) >> self.shift


def labelled_ids(labels: DataFrame) -> DataFrame:
    """Every labelled id once: (doc_id, good)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good is not null")
    return usable.groupBy("doc_id").agg(F.min("good").alias("good")).where("good in (0, 1)")


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def fold(doc_id: int) -> int:
    """The half of the documents that an id belongs to."""
    return zlib.crc32(str(doc_id).encode()) & 1


def marked(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, text, good), good null where not labelled good. By a hash join of shuffled rows at every size: a broadcast
    would grow with the labels, and a merge join would sort the texts."""
    return id_and_text(docs).join(labelled.where("good = 1").hint("shuffle_hash"), "doc_id", "left")


def corpus_counts(docs: DataFrame, labelled: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket counts over every document, and over each half of the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = Hasher(bits), np.zeros((3, 1 << bits), np.int64)
        for batch in batches:
            ids, texts, good = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("good").to_pylist()
            for lo, hi in slices(texts):
                found: list[list[np.ndarray]] = [[], [], []]
                for k, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    found[0].append(hasher.buckets(_words(text)))
                    if good[lo + k]:
                        found[1 + fold(ids[lo + k])].append(found[0][-1])
                for row, own in enumerate(found):
                    if own:
                        counts[row] += np.bincount(np.concatenate(own).astype(np.int64), minlength=1 << bits)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, *counts[:, seen])], names=["bucket", "raw", "good0", "good1"])

    names = ["raw", "good0", "good1"]
    counted = marked(docs, labelled).mapInArrow(run, "bucket long, raw long, good0 long, good1 long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    out = np.zeros((3, 1 << bits))
    for row in counted.collect():  # as many rows as buckets at most
        out[:, row["bucket"]] = [row[c] for c in names]
    return out


def likelihood_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log ratio of the two multinomials; the target's is smoothed towards the raw one."""
    if not good.sum() or not raw.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    strength = 0.05 * good.sum()
    return np.log((good + strength * p_raw) / (good.sum() + strength)) - np.log(p_raw)


def threshold(scores: np.ndarray, good: np.ndarray, max_lost: float = MAX_LOST) -> float:
    """The cut with the largest gain of poor below over good below, among those losing few good ones; ``best_cut`` of scores in memory."""
    if not len(scores) or not good.any():
        return -np.inf
    cuts = np.unique(scores)
    fine = np.sort(scores[good])
    lost = np.searchsorted(fine, cuts, "left") / len(fine)
    poor = np.sort(scores[~good])
    caught = np.searchsorted(poor, cuts, "left") / max(1, len(poor))
    gain = np.where(lost <= max_lost, caught - lost, -1.0)
    best = int(gain.argmax())
    return float((cuts[best] + cuts[best - 1]) / 2) if best and gain[best] > 0 else -np.inf


def best_cut(scored: DataFrame, max_lost: float = MAX_LOST) -> float:
    """``threshold`` of a table (score, good boolean) of any size: sums by bin on the driver, running sums within bins in tasks."""
    levels = scored.groupBy("score").agg(F.count_if("good").alias("fine"), F.count_if(~F.col("good")).alias("poor"))
    levels = levels.withColumn("bin", F.least(F.greatest(F.floor(F.col("score") * BINS_UNIT), F.lit(-BINS_SIDE)), F.lit(BINS_SIDE)).cast("int"))
    bins = levels.groupBy("bin").agg(F.sum("fine").alias("fine"), F.sum("poor").alias("poor"), F.max("score").alias("top")).orderBy("bin").collect()
    fine = poor = 0
    under, below = None, []
    for r in bins:
        below.append((r["bin"], fine, poor, under))
        fine, poor, under = fine + r["fine"], poor + r["poor"], r["top"]
    if not fine:
        return -np.inf
    start = scored.sparkSession.createDataFrame(below, "bin int, fine_below long, poor_below long, under double")
    own = Window.partitionBy("bin").orderBy("score")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    so_far = {c: F.col(f"{c}_below") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("fine", "poor")}
    cuts = levels.join(F.broadcast(start), "bin").select("score", (so_far["fine"] / fine).alias("lost"), (so_far["poor"] / max(1, poor)).alias("caught"), F.coalesce(F.lag("score").over(own), "under").alias("under"))
    best = cuts.withColumn("gain", F.col("caught") - F.col("lost")).where(F.col("under").isNotNull() & (F.col("lost") <= max_lost) & (F.col("gain") > 0)).orderBy(F.desc("gain"), "score").first()
    return (best["score"] + best["under"]) / 2 if best else -np.inf


def digest(docs: DataFrame, ratio: np.ndarray, halves: list[np.ndarray]) -> DataFrame:
    """Base counts of every whole text, its score, and its cross-fitted score by the ratios of the half that its id is not in."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, crossed double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(ratio).bit_length() - 1)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in slices(texts):
                rows = []
                for doc_id, text in zip(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    words = _words(text)
                    counts = base_counts(text, words)
                    buckets = hasher.buckets(words)
                    crossed = ratio if doc_id is None else halves[1 - fold(doc_id)]
                    rows.append((*counts, base_failed(counts[0], counts[4]), *(float(x[buckets].mean()) if words else 0.0 for x in (ratio, crossed))))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return id_and_text(docs).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on every label and the whole corpus, and judge every document."""
    labelled = labelled_ids(labels)
    raw, *halves = corpus_counts(docs, labelled)
    judged = materialize(digest(docs, likelihood_ratio(raw, sum(halves)), [likelihood_ratio(raw, h) for h in halves]))
    cut = best_cut(judged.where("not base_failed").join(labelled, "doc_id").select(F.col("crossed").alias("score"), (F.col("good") == 1).alias("good")))
    kept = (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "score")
