"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 8).

A byte string's merge-order encoding has one valid last token for each of its
prefixes: the token T ending there whose left neighbour, the last token of the
prefix before T, stays apart from T under the merge order. ``PrefixBPE`` keeps
the last tokens of prefixes it has met, at a few lengths with all before them,
so strings that share a prefix share its work, appending bytes only adds prefixes, and an edit re-encodes
only what lies behind it (``Encoding``).

Two adjacent tokens stay apart if no merge crosses their border while both
sides are built: the left side's right edge and the right side's left edge are
walked through the merges that made them.

Defined results: a null text is the empty text (no tokens); an empty table
gives no rows; repeated rows are kept; a null doc_id stays null; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .tokens import slices

#: White space in the splitting pattern's sense (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries that each of a worker's tables may hold before it starts afresh (half for prefixes).
TABLE_SIZE = 450_000
#: Lengths of the prefixes that are kept, each with the last tokens of all before it.
STOPS = (12, 8, 4)
#: Chunks and pieces that a worker keeps, each in two halves of which the one not used of late goes.
KEPT = 600_000
#: Punctuation that is a match of its own behind a word.
TAIL = ".,;:!?"
#: Bytes of a match, or characters of a chunk, above which it is encoded by a list of its own and not kept.
LONG = 256
_codecs: dict[tuple[str, str], Codec] = {}


class PrefixBPE:
    """Merge-order encoding of byte strings by last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.last: dict[bytes, tuple[int, tuple[int, ...]]] = {}  # prefix -> state, last tokens of it and its own prefixes
        self.apart: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}
        # An automaton over bytes: a state is the longest end of what was read that begins a token, with the tokens that end there.
        self.begins = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self._restart()

    def _restart(self) -> None:
        self.last = {}
        self.states, self.names = {b"": 0}, [b""]
        self.ending: list[list[tuple[int, int]]] = [[]]  # by state: (size, token), longest first
        self.go: dict[int, int] = {}

    def _step(self, state: int, byte: int) -> int:
        name = self.names[state] + bytes((byte,))
        while name not in self.begins:
            name = name[1:]
        after = self.states.get(name)
        if after is None:
            after = self.states[name] = len(self.names)
            self.names.append(name)
            tokens = [(len(name) - k, self.ranks.get(name[k:])) for k in range(len(name))]
            self.ending.append([(size, t) for size, t in tokens if t is not None and self.made_of(t) is not None])
        self.go[state << 8 | byte] = after
        return after

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging: the lowest rank first, leftmost first. With ``below``, only by lower ranks."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60 or below is not None and rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a byte, None if merging never makes it."""
        if token not in self.halves:
            data = self.tokens[token]
            if len(data) == 1:
                self.halves[token] = (token, token)
            else:
                parts = self.merge(data, token)
                self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._border(left, right)
        return known

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The tokens at a token's right or left edge: bytes, the rank of the merge that makes them (0: a byte) and of that which consumes them."""
        known = self.edges.get((token, right))
        if known is None:
            known, gone = [], 1 << 60
            while True:
                data = self.tokens[token]
                known.append((data, token if len(data) > 1 else 0, gone))
                made = self.made_of(token)
                if not made or made[right] == token:
                    break
                token, gone = made[right], token
            self.edges[known[0][1] if len(known[0][0]) > 1 else token, right] = known
        return known

    def _border(self, left: int, right: int) -> bool:
        lefts = self._edge(right, False)
        for x, x_made, x_gone in self._edge(left, True):
            for y, y_made, y_gone in lefts:
                rank = self.ranks.get(x + y)
                if rank is not None and max(rank, x_made, y_made) < x_gone and rank <= y_gone:
                    return False
        return True

    def extend(self, data: bytes) -> list[int]:
        """The last tokens of all prefixes of ``data`` by length (0: none), from its longest prefix that is kept on."""
        go, ending, apart = self.go, self.ending, self.apart
        state, lasts = 0, [-1]
        for stop in STOPS:
            if len(data) >= stop and (known := self.last.get(data[:stop])):
                state, lasts = known[0], list(known[1])
                break
        for end in range(len(lasts), len(data) + 1):
            byte = data[end - 1]
            after = go.get(state << 8 | byte)
            state = self._step(state, byte) if after is None else after
            for size, token in ending[state]:
                if size == end:
                    break
                left = lasts[end - size]
                alone = apart.get(left << 32 | token)
                if self.stays_apart(left, token) if alone is None else alone:
                    break
            lasts.append(token)
            if end in STOPS:
                self.last[data[:end]] = state, tuple(lasts)
        return lasts

    def encode(self, data: bytes) -> list[int]:
        if data in self.ranks:  # a whole match that is a token is that token
            return [self.ranks[data]]
        if len(self.apart) > TABLE_SIZE:
            self.apart = {}
        if len(self.go) > TABLE_SIZE:
            self._restart()
        if len(data) > LONG:
            return Encoding(self, data).ids()
        if len(self.last) > TABLE_SIZE // 2:
            self.last = {}
        lasts = self.extend(data)
        out, end = [], len(data)
        while end:
            token = lasts[end]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]


class Encoding:
    """The encoding of one byte string under appends and edits. ``lasts[k]``: the last token of the first k + 1 bytes."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data = bpe, b""
        self.lasts: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        bpe = self.bpe
        for end in range(len(self.lasts) + 1, len(self.data) + 1):
            for size in range(min(end, bpe.longest), 0, -1):
                token = bpe.ranks.get(self.data[end - size:end])
                if token is not None and bpe.made_of(token) is not None and (size == end or bpe.stays_apart(self.lasts[end - size - 1], token)):
                    self.lasts.append(token)
                    break

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes [start, end): prefixes up to ``start`` keep their last tokens."""
        data = self.data[:start] + new + self.data[end:]
        self.data, self.lasts = data[:start], self.lasts[:start]
        self.append(data[start:])

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.lasts[end - 1])
            end -= len(self.bpe.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Texts to ids and back, each match of ``pattern`` separately."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        with open(path, "rb") as lines:
            self.bpe = PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
        self.matches = regex.compile(pattern).findall
        # A match never spans the border between a character and white space behind it, so chunks of
        # white space and what follows are split apart on their own.
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: tuple[dict[str, tuple[str, int, bytes]], dict[str, tuple[int, ...]]] = {}, {}

    def ids(self, chunk: str) -> list[int]:
        core = chunk.rstrip(TAIL)
        if core.isalpha() or core[:1] == " " and core[1:].isalpha():
            pieces = [core, chunk[len(core):]] if len(core) < len(chunk) else [core]
        else:
            pieces = self.matches(chunk)
        found = []
        for piece in pieces:
            known = self.pieces.get(piece)
            if known is None:
                known = self.older[1].get(piece)
                if known is None:
                    known = tuple(self.bpe.encode(piece.encode()))  # the garbage collector passes tuples of numbers over
                if len(piece) <= LONG:
                    self.pieces[piece] = known
            found += known
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bpe.tokens[i] for i in ids])

    def coded(self, text: str) -> list[tuple[str, int, bytes]]:
        """For each chunk: its ids in decimal, how many, and the bytes they decode to."""
        if len(self.cache) > KEPT // 2:
            self.cache, self.older = {}, (self.cache, self.older[1])
        if len(self.pieces) > KEPT // 2:
            self.pieces, self.older = {}, (self.older[0], self.pieces)
        cache, older = self.cache, self.older[0]
        chunks = self.chunks(text)
        out = list(map(cache.get, chunks))
        if None in out:
            for k, known in enumerate(out):
                if known is None:
                    chunk = chunks[k]
                    if (known := cache.get(chunk)) is None:
                        if (known := older.get(chunk)) is None:
                            ids = self.ids(chunk)
                            known = (" ".join(map(str, ids)), len(ids), self.decode(ids))
                        if len(chunk) <= LONG:
                            cache[chunk] = known
                    out[k] = known
        return out

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.ids(chunk)]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    file, pat = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pat)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                ids = [c.encode(t) for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids)."""
    file, pat = _defaults(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pat)
        for batch in batches:
            decoded = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, then decode, every whole text; digests of both in one pass over the texts."""
    file, pat = _defaults(path, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file, pat)
        for batch in batches:
            count, ids_hash, text_hash = [], [], []
            for text in batch.column("text"):
                decimal, sizes, decoded = zip(*c.coded(text.as_py()), strict=True) if text.as_py() else ((), (), ())
                count.append(sum(sizes))
                ids_hash.append(hashlib.sha256(" ".join(decimal).encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, schema)
