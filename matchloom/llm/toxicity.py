"""Toxicity by subword-bag embeddings under a linear softmax (operator 9).

A word is the bag of its hashed character n-grams (and itself), a window of
words is the mean of its words' mean n-gram vectors, and a linear softmax over
that mean gives the class. Embeddings and softmax are trained jointly in numpy
on a bounded sample of labelled rows, at most ``MAX_WORDS`` words of each; a
misspelling never seen shares most of its n-grams, and so their vectors, with
words that were. Training is one executor task: the driver holds the model
only, never the sample.

A label speaks of a whole document while a few words may earn it. So a document
counts by its highest window, both in training (the windows are chosen anew in
each round) and in scoring, however long the text is. The last fifth of the
sample calibrates the document score.

Defined results: a null text is the empty text; a text without words has the
score of an empty window; no labelled rows, or rows of one class only, give a
score of 0 to every document; rows repeated in the labels count once (the
higher label); null labels are ignored; rows of a null doc_id are scored, never
learnt from, and not held out; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, small_batches
from .tokens import slices

BUCKET_BITS = 19
DIM = 8
WINDOW, STRIDE = 8, 4
#: Labelled rows of each class that training may gather, and words of each row: its only bounds. Scoring has none.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 3000
MAX_WORDS, BLOCK_WORDS = 2048, 128
THRESHOLD = 0.7
#: Words whose scores a worker keeps, and bytes of text that are scored together.
CACHE_WORDS, GROUP_BYTES = 250_000, 1 << 20
LOW, HIGH = 3, 6
#: Characters above which a run is split, and those of a part: about two words, so that a window spans as much text as elsewhere.
LONG_RUN, PART = 64, 16
_words = re.compile(r"\w+").findall


def parts_of(run: str) -> list[str]:
    """The run itself, or the parts of a long one; neighbours share all but one character of the longest n-gram."""
    if len(run) <= LONG_RUN:
        return [run]
    shared = HIGH - 1
    return [run[k:k + PART] for k in range(0, len(run) - shared, PART - shared)]


def words_of(text: str) -> list[str]:
    words = _words(text.lower())
    if max(map(len, words), default=0) > LONG_RUN:
        return [part for w in words for part in parts_of(w)]
    return words


def ngram_ids(word: str, bits: int = BUCKET_BITS, low: int = LOW, high: int = HIGH) -> list[int]:
    """Hashed n-grams of ``<word>`` and of the word as a whole."""
    mask = (1 << bits) - 1
    data = f"<{word}>"
    grams = {data[i:i + n] for n in range(low, high + 1) for i in range(len(data) - n + 1)}
    return sorted({zlib.crc32(g.encode()) & mask for g in grams | {data, "=" + word}})


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many stretches of one byte string."""
    crc, size = np.full(len(start), 0xFFFFFFFF, np.uint32), end - start
    on = np.arange(len(start))
    for k in range(int(size.max(initial=0))):
        on = on[size[on] > k]
        crc[on] = _TABLE[(crc[on] ^ data[start[on] + k]) & 0xFF] ^ crc[on] >> 8
    return crc ^ np.uint32(0xFFFFFFFF)


def bags(words: list[str], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``ngram_ids`` of all words in one row, and how many each has."""
    parts = [_bags(words[k:k + at_once]) for k in range(0, len(words), at_once)]
    ids, sizes = zip(*parts, strict=True) if parts else ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)])
    return np.concatenate(ids), np.concatenate(sizes)


def _bags(words: list[str], bits: int = BUCKET_BITS, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join([f"<{w}>={w}" for w in words]).encode(), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters start
    chars = np.array([len(w) for w in words])
    first = np.cumsum(2 * chars + 3) - (2 * chars + 3)  # of <word>, in characters
    owners, starts, ends = [np.tile(np.arange(len(words)), 2)], [at[first], at[first + chars + 2]], [at[first + chars + 2], at[first + 2 * chars + 3]]
    for n in range(low, high + 1):
        count = np.maximum(chars + 3 - n, 0)
        owner = np.repeat(np.arange(len(words)), count)
        begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        owners.append(owner)
        starts.append(at[begin])
        ends.append(at[begin + n])
    key = np.unique(np.concatenate(owners) << bits | _crc32(data, np.concatenate(starts), np.concatenate(ends)) & (1 << bits) - 1)
    return (key & (1 << bits) - 1).astype(np.int32), np.bincount(key >> bits, minlength=len(words))


def window_starts(n_words: int) -> np.ndarray:
    return np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE)


@dataclass
class ToxicityModel:
    """Per-bucket evidence (embedding times softmax difference), bias and calibration."""

    evidence: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, words: list[str]) -> list[float]:
        """Mean evidence of each word's n-grams."""
        ids, sizes = bags(words)
        return (np.add.reduceat(self.evidence[ids], np.cumsum(sizes) - sizes) / sizes).tolist() if words else []

    def window_logits(self, scores: np.ndarray) -> np.ndarray:
        if not len(scores):
            return np.array([self.bias])
        sums, starts = np.concatenate([[0.0], np.cumsum(scores)]), window_starts(len(scores))
        ends = np.minimum(starts + WINDOW, len(scores))
        return (sums[ends] - sums[starts]) / WINDOW + self.bias

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))))


class _Sample:
    """Labelled documents as windows over a vocabulary with n-gram lists."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.labels = labels
        vocabulary: dict[str, int] = {"": 0}
        codes = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32) for text in texts]
        sizes = np.array([len(c) for c in codes])
        words = np.concatenate([*codes, np.zeros(WINDOW, np.int32)])
        counts = np.array([len(window_starts(n)) for n in sizes])
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        begin = np.cumsum(sizes) - sizes
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = (begin[self.doc] + STRIDE * nth)[:, None] + np.arange(WINDOW)
        self.windows = np.where(place < (begin + sizes)[self.doc][:, None], words[np.minimum(place, len(words) - 1)], 0).astype(np.int32)
        grams, sizes = bags(list(vocabulary)[1:])
        self.grams, self.sizes = grams, np.concatenate([[0], sizes])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def bag(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams, their window, their weight in the window's mean)."""
        words = windows.ravel()
        sizes = self.sizes[words]
        total = int(sizes.sum())
        place = np.arange(total) + np.repeat(self.starts[words] - (np.cumsum(sizes) - sizes), sizes)
        owner = np.repeat(np.arange(len(words)) // WINDOW, sizes)
        return self.grams[place], owner, np.repeat(1.0 / (WINDOW * np.maximum(sizes, 1)), sizes)

    def logits(self, evidence: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(evidence[self.grams])])
        score = (sums[self.starts[1:]] - sums[self.starts[:-1]]) / np.maximum(self.sizes, 1)
        return sum(score[self.windows[:, k]] for k in range(WINDOW)) / WINDOW + bias

    def highest(self, logits: np.ndarray) -> np.ndarray:
        """The window of highest logit of each document."""
        order = np.lexsort((-logits, self.doc))
        first = np.concatenate([[True], self.doc[order][1:] != self.doc[order][:-1]])
        return order[first]


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int = 10, rate: float = 1.0) -> ToxicityModel | None:
    """Fit embeddings and softmax jointly; None where the labels hold one class only."""
    y = np.array(labels, np.int64)
    if len(y) < 10 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    fit = _Sample([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    if fit.labels.min() == fit.labels.max():
        return None
    n = 1 << BUCKET_BITS
    vectors = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    softmax, offset = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen, seen_soft = np.full(n, 1e-5, np.float32), 1e-6
    window_label = fit.labels[fit.doc]
    for r in range(rounds):
        logits = fit.logits(vectors @ (softmax[:, 1] - softmax[:, 0]), offset[1] - offset[0])
        positive = np.flatnonzero(window_label == 1)
        negative = np.flatnonzero(window_label == 0)
        n_pos = int(fit.labels.sum())
        if r < 3:  # no windows are known to carry the label yet
            chosen = [rng.permutation(positive)[:8 * n_pos], rng.permutation(negative)[:8 * n_pos]]
        else:
            top = fit.highest(logits)
            hard = top[fit.labels[fit.doc[top]] == 0]
            chosen = [np.repeat(top[fit.labels[fit.doc[top]] == 1], 2), hard, rng.permutation(negative)[:2 * n_pos]]
        for batch in np.array_split(order := rng.permutation(np.concatenate(chosen)), max(1, len(order) // min(256, max(24, len(order) // 120)))):
            grams, owner, weight = fit.bag(fit.windows[batch])
            mean = np.stack([np.bincount(owner, weight * vectors[grams, d], len(batch)) for d in range(DIM)], 1)
            z = mean @ softmax + offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), window_label[batch]] -= 1  # gradient at the logits
            at_mean, at_soft = p @ softmax.T, mean.T @ p / len(batch)
            rows, slot = np.unique(grams, return_inverse=True)
            step = np.stack([np.bincount(slot, weight * at_mean[owner, d], len(rows)) for d in range(DIM)], 1)
            seen[rows] += (step**2).mean(1)
            vectors[rows] -= rate * step / np.sqrt(seen[rows])[:, None]
            seen_soft += (at_soft**2).mean()
            softmax -= rate * 0.1 * at_soft / np.sqrt(seen_soft)
            offset -= rate * 0.05 * p.mean(0)
    evidence, bias = vectors @ (softmax[:, 1] - softmax[:, 0]), float(offset[1] - offset[0])
    del fit, vectors, seen
    rest = _Sample([t for t, h in zip(texts, held, strict=True) if h], y[held])
    logit = rest.logits(evidence, bias)
    slope, shift = _calibrate(logit[rest.highest(logit)], rest.labels)
    return ToxicityModel(evidence, bias, slope, shift)


def _calibrate(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Logistic fit of the label on the highest window's logit, with a small pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 0.05), float(b)


def excerpt(text: str, most: int = MAX_WORDS, block: int = BLOCK_WORDS) -> str:
    """The words of a text; of a longer one, whole blocks of neighbouring words, in hash order up to ``most`` words, where they stand."""
    words = words_of(text)
    if len(words) <= most:
        return " ".join(words)
    blocks = [" ".join(words[k:k + block]) for k in range(0, len(words), block)]
    chosen = sorted(range(len(blocks)), key=lambda k: (zlib.crc32(blocks[k].encode("utf-8", "replace")), k))[:most // block]
    return " ".join(blocks[k] for k in sorted(chosen))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """(doc_id, text, label): excerpts of a bounded sample, the first of each class in hash order, never of rows whose crc32(doc_id) mod 3 is 1."""
    key = F.col("doc_id").cast("long")
    usable = labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = usable.where("label = 1").orderBy(*order).limit(max_positive).union(usable.where("label = 0").orderBy(*order).limit(max_negative))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([excerpt(t.as_py()) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("label")], names=["doc_id", "text", "label"])

    # Rows that share a labelled id are one: the first by hash of the text, so that the bound holds.
    rows = id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").mapInArrow(cut, "doc_id long, text string, label int")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row")).select("doc_id", "row.text", "row.label")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """The model of the labelled sample, trained by one executor task; None where the labels hold one class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: list[tuple[int, str, int]] = []
        for batch in batches:
            sample += zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "label")], strict=True)
        sample.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        if model := train([text for _, text, _ in sample], [label for _, _, label in sample]):
            row = {"evidence": model.evidence.astype("<f8").tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("evidence", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())]))

    found = labelled_sample(docs, labels).repartition(1).mapInArrow(run, "evidence binary, bias double, slope double, shift double").collect()
    return ToxicityModel(np.frombuffer(found[0]["evidence"], "<f8"), *found[0][1:]) if found else None


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 3 == 1


class _Scorer:
    """Scores of texts, with a bounded cache of word scores."""

    def __init__(self, model: ToxicityModel | None):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> list[float]:
        if self.model is None:
            return [0.0] * len(texts)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        docs = [words_of(t) for t in texts]
        unseen = [w for w in dict.fromkeys(chain.from_iterable(docs)) if w not in known]
        known.update(zip(unseen, self.model.word_scores(unseen), strict=True))
        scores = (np.fromiter(map(known.__getitem__, words), np.float64, len(words)) for words in docs)
        return [self.model.probability(self.model.window_logits(s).max()) for s in scores]


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for lo, hi in slices(batch.column("text"), GROUP_BYTES):
                out = scorer(batch.column("text").slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts = batch.column(at).fill_null("")
            for lo, hi in slices(texts, GROUP_BYTES):
                kept = [s < THRESHOLD for s in scorer(texts.slice(lo, hi - lo).to_pylist())]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of it."""
    return score(docs, fit(docs, labels))
