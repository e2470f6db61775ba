"""Exact removal of repeated byte strings by blockwise suffix sorting (operator 3).

A byte goes if a ``length``-byte string that covers it starts anywhere else
too. Whether it does shows where two suffixes agree in ``length`` bytes, so
suffixes are sorted, one bucket at a time.

1. Buckets. The suffixes that start at positions whose ``length``-byte windows
   have their smallest k-gram (by a mixed rolling hash, leftmost on ties) at
   the same place form a run; equal windows have equal k-grams there, so the
   k-gram's hash is a bucket that brings all suffixes with a common window
   together. A run's text, from its first window's first byte to its last
   window's last, is its context. Runs are counted by (bucket, context hash)
   before any text moves: of equal contexts one is sorted for all, a bucket
   with one context needs no sorting, and only a representative of each other
   context sends its text.
2. Sorting (``repeated_suffixes``). A task lays the contexts of its buckets
   out as one text and ranks the positions of a difference cover modulo 16 by
   prefix doubling to ``length`` less 16 bytes. Then it takes one block of
   suffixes of equal leading bytes after another and sorts it: first 16 bytes,
   then, as any two suffixes have a common shift below 16 at which both lie in
   the cover sample, the ranks of the sample there, then the last 16 bytes.
3. A bucket of more than ``BUCKET_CONTEXTS`` differing contexts is split before
   it is sorted, as often as needed (``_split``): equal windows lie at equal
   distances from the k-gram, so contexts are cut into cells of ``CELL`` windows
   at like distances, and the bytes that all windows of a cell hold make a
   bucket of their own. Equal parts are merged again, what remains is sorted
   the same way, and a bucket still too large is split into smaller cells. With
   cells of one window every bucket holds one part, so this ends, and no task
   sorts more than a bounded bucket, however many copies a group has.

Two scales in one call: with ``passage`` below ``length`` the same work is done
at the smaller scale first; strings of ``length`` bytes that repeat lie inside
what repeats there, so the second pass looks at those spans alone.

Rows are told apart by doc_id and 64 bits of their text's hash (null ids: by
128 bits of it). Hashes have 64 bits twice (bucket and context, or bucket and
part), so equal means equal but for a collision of 128 bits.

Defined results: a null text is the empty text; texts shorter than ``length``
lose nothing; repeated rows are copies of each other and lose all their
windows; a null doc_id stays null, and rows of null or shared ids count as the
documents that they are; an empty table gives no rows; extra columns are
ignored, whatever their names (``dedup`` with ``with_text`` carries them in
``rest``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_column
from .simhash import whole_runs

LENGTH = 400
#: Bytes of a repeated passage: no more than 51 words of running text take, about.
PASSAGE = 240
#: Bytes of the k-gram that names a bucket, for windows of ``length`` bytes.
GRAM = 48
#: Differing contexts of a bucket that are sorted together; larger buckets are split.
BUCKET_CONTEXTS = 128
#: Window starts of a cell in the first split of a bucket, and by how much each further split divides them.
CELL, FINER = 32, 4
#: Text that is ranked at once, and suffixes of a block.
RANKED_BYTES, BLOCK_SUFFIXES = 4 << 20, 1 << 17
#: Window starts of a long text that are scanned at once.
SCAN = 1 << 18
PERIOD = 16
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def difference_cover(period: int = PERIOD) -> list[int]:
    """The first smallest set whose differences are all residues modulo ``period``."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return list(range(period))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def window_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(first window start, number of window starts, place of their common smallest k-gram)."""
    windows = len(data) - length + 1
    width = length - gram + 1
    for base in range(0, max(0, windows), SCAN):
        m = min(SCAN, windows - base)
        part = np.frombuffer(data, np.uint8, m + length - 1, base).astype(np.uint64) + np.uint64(1)
        up, down = _power(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # place in the low bits: leftmost on ties
        span = 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        least = np.minimum(h[:m], h[width - span:width - span + m]) & np.uint64((1 << 20) - 1)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.append(starts[1:], m)
        yield from zip((base + starts).tolist(), (ends - starts).tolist(), (base + least[starts].astype(np.int64)).tolist(), strict=True)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two ranks (-1 for none) as one key of the same order."""
    return (first + 1).astype(np.uint64) << np.uint64(32) | (second + 1).astype(np.uint64)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of a key."""
    order = np.argsort(key)
    s = key[order]
    new = np.zeros(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_suffixes(contexts: list[bytes], owned: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its first ``owned`` windows equal another window of any context here."""
    text = b"".join(contexts) + bytes(2 * length)
    n = len(text) - 2 * length
    data = np.frombuffer(text, np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(data[:n + length + 8], 8).copy().view(">u8").ravel()
    half = _ranks(words[:n + length - PERIOD + 8])  # first 8 bytes at every position, then 16
    head = _ranks(_joined(half[:-8], half[8:]))
    cover = difference_cover()
    in_cover = np.zeros(PERIOD, bool)
    in_cover[cover] = True
    sample = np.flatnonzero(in_cover[np.arange(n) % PERIOD])
    place = np.full(n + 2 * length, -1, np.int64)
    place[sample] = np.arange(len(sample))

    def behind(rank: np.ndarray, shift: int) -> np.ndarray:
        at = place[sample + shift]  # the cover repeats with its period, so these are samples too, or past the end
        return np.where(at >= 0, rank[at], -1)

    # Ranks of the sample by prefix doubling, then by the parts of what is left.
    depth, rank = PERIOD, head[sample]
    wanted = length - PERIOD
    steps = {depth: rank}
    while depth * 2 <= wanted:
        rank = _ranks(_joined(rank, behind(rank, depth)))
        depth *= 2
        steps[depth] = rank
    while depth < wanted:
        more = max(d for d in steps if d <= wanted - depth)
        rank = _ranks(_joined(rank, behind(steps[more], depth)))
        depth += more
    starts = np.cumsum([0] + [len(c) for c in contexts])[:-1]
    suffix = np.arange(int(owned.sum())) + np.repeat(starts - (np.cumsum(owned) - owned), owned)
    found = np.zeros(len(suffix), bool)
    order = np.argsort(head[suffix])
    lead = head[suffix[order]]
    at = 0
    while at < len(order):  # one block of suffixes at a time, cut where the leading bytes change
        end = min(at + BLOCK_SUFFIXES, len(order))
        if end < len(order):
            end = int(np.searchsorted(lead, lead[end], "left"))
            if end <= at:
                end = int(np.searchsorted(lead, lead[at], "right"))
        block = order[at:end]
        if end - at > 1:
            _sort_block(block, suffix[block], head, rank, place, length, in_cover, found)
        at = end
    return np.split(found, np.cumsum(owned)[:-1])


def _sort_block(block: np.ndarray, suffix: np.ndarray, head: np.ndarray, rank: np.ndarray, place: np.ndarray, length: int, in_cover: np.ndarray, found: np.ndarray) -> None:
    tail = head[suffix + length - PERIOD]
    for shift in range(PERIOD):
        own = np.flatnonzero(in_cover[(suffix + shift) % PERIOD])
        if len(own) < 2:
            continue
        key = _joined(head[suffix[own]], rank[place[suffix[own] + shift]])
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        alike = np.zeros(len(own), bool)  # only suffixes that agree so far are told apart by their last bytes
        alike[1:] = same
        alike[:-1] |= same
        own = own[order[alike]]
        group = np.cumsum(np.concatenate([[True], ~same])[alike])
        key = _joined(group, tail[own])
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        found[block[own[order[1:][same]]]] = True
        found[block[own[order[:-1][same]]]] = True


def runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, mark, place, kh, ch): every run of window starts by bucket and context hash, inside ``spans`` where texts have such a column. place: start and size."""
    spans_at = texts.columns.index("spans") if "spans" in texts.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        hash64, unpress = xxhash.xxh3_64_intdigest, zstandard.ZstdDecompressor()
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            out: list[tuple[int, int, int, int, int]] = []
            for n, (i, mark, text) in enumerate(zip(ids, marks, batch.column(2).cast(pa.binary()), strict=True)):
                data = text.as_py()
                if spans_at is None:
                    spans = [(0, len(data))]
                else:
                    data = unpress.decompress(data)
                    ends = batch.column(spans_at)[n].as_py()
                    spans = list(zip(ends[::2], ends[1::2], strict=True))
                for lo, hi in spans:
                    part = data[lo:hi]
                    for start, size, at in window_runs(part, length, gram):
                        out.append((i, mark, (lo + start) << 18 | size - 1, hash64(part[at:at + gram]), hash64(part[start:start + size + length - 1], at - start)))
                if len(out) > 50_000:
                    yield _longs(out)
                    out = []
            if out:
                yield _longs(out)

    return texts.mapInArrow(run, "id long, mark long, place long, kh long, ch long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 == 1 else x


def _longs(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    """The first three columns are signed, the hashes behind them are not."""
    columns = [pa.array(np.array(c, np.int64 if k < 3 else np.uint64).view(np.int64)) for k, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "mark", "place", "kh", "ch"])


def _unpack(place: int) -> tuple[int, int]:
    return place >> 18, (place & (1 << 18) - 1) + 1


def _lead(context: bytes, kh: int, gram: int) -> int:
    """Where a context's k-gram starts: its first occurrence, as the leftmost of equals names a run."""
    import xxhash

    wanted = kh % (1 << 64)
    return next(d for d in range(len(context)) if xxhash.xxh3_64_intdigest(context[d:d + gram]) == wanted)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, id, mark, text, rest): id and mark identify a row but for equal ones, rest holds the other columns."""
    small_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.struct(*others).alias("rest"))
    return rows.select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")).alias("id"), F.xxhash64("text").alias("mark"), "text", "rest")


def _packed(texts: DataFrame) -> DataFrame:
    """Compress the texts before they are shuffled: ``text`` becomes ``z``."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([press.compress(t.as_py()) for t in batch.column(at).cast(pa.binary())], pa.binary())
            names = [n if k != at else "z" for k, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([c if k != at else data for k, c in enumerate(batch.columns)], names=names)

    return texts.mapInArrow(run, StructType([f if f.name != "text" else StructField("z", BinaryType()) for f in texts.schema.fields]))


_MARKS = "kh long, ch long, k int, size int, bits binary"
_PARTS = "key long, ph long, kh long, ch long, k int, size int, lead int, known boolean, part binary"


def repeated_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, within: DataFrame | None = None) -> DataFrame:
    """(id, mark, marks array<struct<place, bits>>): runs holding repeated windows; bits null: all of them.

    ``within``: (id, mark, spans) outside of which nothing repeats.
    """
    copies = _packed(texts.select("id", "mark", "text"))
    if within is None:
        scanned = texts.select("id", "mark", "text")
    else:
        scanned = copies.join(within, ["id", "mark"]).select("id", "mark", "z", "spans")
    own = materialize(runs(scanned, length, gram))
    contexts = materialize(own.groupBy("kh", "ch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "mark", "place")).alias("first")))
    buckets = materialize(contexts.groupBy("kh").agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n_runs")).where("n_runs > 1").select("kh", "n_contexts"))
    shared = materialize(contexts.join(buckets, "kh"))
    whole = shared.where("n > 1").select("kh", "ch", F.lit(None).cast("binary").alias("bits"))
    wanted = shared.where("n_contexts > 1").select(
        "first.id", "first.mark",
        F.struct("kh", "ch", F.col("first.place").alias("place"), (F.col("n") > 1).alias("known"), (F.col("n_contexts") > BUCKET_CONTEXTS).alias("hot")).alias("r"),
    )
    asked = wanted.groupBy("id", "mark").agg(F.collect_list("r").alias("rs"))  # of one document: bounded by its length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, rs in zip(batch.column("z"), batch.column("rs").to_pylist(), strict=True):
                data = unpress.decompress(z.as_py())
                for r in rs:
                    start, size = _unpack(r["place"])
                    context = data[start:start + size + length - 1]
                    rows.append((r["kh"], r["ch"], r["kh"], r["ch"], 0, size, _lead(context, r["kh"], gram) if r["hot"] else 0, r["known"], context, r["hot"]))
            yield _part_rows(rows, hot=True)

    # Equal rows have the same contexts: one of them answers.
    cuts = materialize(copies.dropDuplicates(["id", "mark"]).join(asked, ["id", "mark"]).select("z", "rs").mapInArrow(cut, _PARTS + ", hot boolean"))
    found = [_sorted(cuts.where("not hot").drop("hot"), length), *_split(cuts.where("hot").drop("hot"), length, CELL)]
    bits = _run_bits(reduce(DataFrame.union, found))
    flagged = materialize(whole.union(bits))
    marked = own.join(flagged, ["kh", "ch"]).select("id", "mark", F.struct("place", "bits").alias("m"))
    return marked.groupBy("id", "mark").agg(F.collect_list("m").alias("marks"))


def _part_rows(rows: list[tuple], hot: bool = False) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()] + [pa.bool_()] * hot
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    names = ["key", "ph", "kh", "ch", "k", "size", "lead", "known", "part"] + ["hot"] * hot
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _sorted(parts: DataFrame, length: int) -> DataFrame:
    """Marks of parts that aren't known to repeat, by suffix sorting within each key."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key"], 2048):
            key, size = table.column("key").to_numpy(), table.column("size").to_numpy()
            ends = np.cumsum([len(c.as_py()) for c in table.column("part")])
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            at = 0
            while at < len(first) - 1:  # whole buckets of bounded text
                base = ends[first[at] - 1] if first[at] else 0
                to = max(at + 1, int(np.searchsorted(ends[first[1:] - 1], base + RANKED_BYTES, "right")))
                lo, hi = first[at], first[to]
                marks = repeated_suffixes([c.as_py() for c in table.column("part").slice(lo, hi - lo)], size[lo:hi].astype(np.int64), length)
                known = table.column("known").slice(lo, hi - lo).to_pylist()
                keep = [k for k, m in enumerate(marks) if not known[k] and m.any()]
                rows = table.slice(lo, hi - lo).select(["kh", "ch", "k", "size"]).take(pa.array(keep, pa.int64())).combine_chunks()
                bits = pa.array([np.packbits(marks[k]).tobytes() for k in keep], pa.binary())
                yield from rows.append_column("bits", bits).to_batches()
                at = to

    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("key", "ph", "kh", "ch", "k", "size", "known", "part").repartition(width, "key").sortWithinPartitions("key", "ph").mapInArrow(sort, _MARKS)


def _split(parts: DataFrame, length: int, cell: int) -> list[DataFrame]:
    """Marks of the parts of too large buckets: cut into cells, equal ones merged, sorted, or split again."""
    if parts.isEmpty():
        return []

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size, lead, data, k = r["size"], r["lead"], r["part"], 0
                while k < size:
                    number = (lead - k) // cell  # the k-gram lies ``lead - k`` bytes behind this window's start
                    end = min(size, lead - number * cell + 1)
                    first = lead - number * cell - cell + 1  # the whole cell's first window, before the part perhaps
                    core, own = data[max(0, first + cell - 1):first + length], data[k:end + length - 1]
                    key = hash64(core, r["kh"] % (1 << 64) ^ number)
                    out.append((_signed(key), _signed(hash64(own, lead - k)), r["kh"], r["ch"], r["k"] + k, end - k, lead - k, r["known"], own))
                    k = end
            yield _part_rows(out)

    cut = materialize(parts.mapInArrow(cells, _PARTS))
    equal = cut.groupBy("key", "ph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kh", "ch", "k")).alias("first"))
    equal = materialize(equal)
    sizes = materialize(equal.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_all")).where("n_all > 1").select("key", "n_parts"))
    shared = materialize(equal.join(sizes, "key").select("key", "ph", "n", "first", "n_parts"))
    copied = cut.where("not known").join(shared.where("n > 1").select("key", "ph"), ["key", "ph"]).select("kh", "ch", "k", "size", F.lit(None).cast("binary").alias("bits"))
    chosen = shared.where("n_parts > 1").select("key", "ph", "first.*", (F.col("n") > 1).alias("copied"), (F.col("n_parts") > BUCKET_CONTEXTS).alias("hot"))
    rest = cut.join(chosen, ["key", "ph", "kh", "ch", "k"]).withColumn("known", F.col("known") | F.col("copied"))
    rest = materialize(rest.select(*cut.columns, "hot"))
    return [copied, _sorted(rest.where("not hot").drop("hot"), length), *_split(rest.where("hot").drop("hot"), length, max(1, cell // FINER))]


def _run_bits(marks: DataFrame) -> DataFrame:
    """(kh, ch, bits): the marks of a run's parts put together."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ms in batch.column("ms").to_pylist():
                bits = np.zeros(max(m["k"] + m["size"] for m in ms), bool)
                for m in ms:
                    own = np.ones(m["size"], bool) if m["bits"] is None else np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["size"]) > 0
                    bits[m["k"]:m["k"] + m["size"]] |= own
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("kh"), batch.column("ch"), pa.array(out, pa.binary())], names=["kh", "ch", "bits"])

    by_run = marks.groupBy("kh", "ch").agg(F.collect_list(F.struct("k", "size", "bits")).alias("ms"))  # of a run: fewer than ``length``
    return by_run.mapInArrow(join, "kh long, ch long, bits binary")


def covered_spans(texts: DataFrame, marks: DataFrame, length: int, least: int) -> DataFrame:
    """(id, mark, spans: start, end, start, end ...): what repeated windows cover, from ``least`` bytes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, own in zip(batch.column("n").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                gone = removed_bytes(n, own, length)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                out.append(edges[edges[:, 1] - edges[:, 0] >= least].ravel().tolist())
            table = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(out, pa.list_(pa.int64()))], names=["id", "mark", "spans"])
            yield table.filter(pa.array([bool(x) for x in out], pa.bool_()))

    sizes = texts.select("id", "mark", F.octet_length("text").alias("n")).dropDuplicates(["id", "mark"])
    return sizes.join(marks, ["id", "mark"]).mapInArrow(run, "id long, mark long, spans array<long>")


def removed_bytes(n: int, marks: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Mask of the bytes that repeated windows cover."""
    at: list[int] = []
    ends: list[int] = []
    single = [np.zeros(0, np.int64)]
    for m in marks or ():
        start, size = _unpack(m["place"])
        if m["bits"] is None:
            at.append(start)
            ends.append(min(n, start + size + length - 1))
        else:
            single.append(start + np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8))))
    apart = np.concatenate(single)
    change = np.bincount(np.concatenate([np.array(at, np.int64), apart]), minlength=n + 1)
    change -= np.bincount(np.concatenate([np.array(ends, np.int64), np.minimum(n, apart + length)]), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def whole_characters(data: bytes, gone: np.ndarray) -> np.ndarray:
    """The mask without characters of which some byte stays."""
    if gone.all() or not gone.any():
        return gone
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    stays = np.bincount(character[~gone], minlength=int(character[-1]) + 1) > 0
    return ~stays[character]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, passage: int | None = None) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256; with ``passage``, also n_passage, the bytes that repeated
    strings of that smaller length cover; ``with_text`` adds what is left as text (whole characters only) and the other columns as rest."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    if any(x % PERIOD or x < 2 * PERIOD for x in (length, passage or length)) or not 0 < gram < min(length, passage or length) or (passage or 0) > length:
        raise ValueError(f"length and passage must be multiples of {PERIOD} from {2 * PERIOD} on, the passage not above length, and gram shorter than both")
    texts = keyed_texts(docs)
    if passage:
        short = materialize(repeated_runs(texts, passage, gram))
        long_ = repeated_runs(texts, length, gram, covered_spans(texts, short, passage, length))
        marks = short.withColumnRenamed("marks", "short").join(long_, ["id", "mark"], "left")
    else:
        marks = repeated_runs(texts, length, gram)
    fields = [StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())]
    fields += [StructField("n_passage", LongType())] * bool(passage)
    if with_text:
        fields += [StructField("text", StringType()), texts.schema["rest"]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            shorts = batch.column("short").to_pylist() if passage else [None] * batch.num_rows
            for doc, z, own, short in zip(batch.column("doc_id").to_pylist(), batch.column("z"), batch.column("marks").to_pylist(), shorts, strict=True):
                data = unpress.decompress(z.as_py())
                if own:
                    gone = removed_bytes(len(data), own, length)
                    whole = np.frombuffer(data, np.uint8)
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    row = (doc, len(data), int(gone.sum()), spans, hashlib.sha256(whole[~gone].tobytes()).hexdigest())
                else:
                    spans, row = 0, (doc, len(data), 0, 0, hashlib.sha256(data).hexdigest())
                if passage:
                    row += (int(removed_bytes(len(data), short, passage).sum()) if short else 0,)
                if with_text:
                    row += ((whole[~whole_characters(data, gone)].tobytes() if spans else data).decode("utf-8", "replace"),)
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * (5 + bool(passage) + with_text)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * bool(passage) + [pa.string()] * with_text
            rest = [batch.column("rest")] if with_text else []
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *rest], names=[f.name for f in fields])

    carried = ["doc_id", "id", "mark", "text"] + ["rest"] * with_text
    joined = _packed(texts.select(*carried)).join(marks, ["id", "mark"], "left")
    return joined.select("doc_id", "z", "marks", *["short"] * bool(passage), *["rest"] * with_text).mapInArrow(apply, StructType(fields))
