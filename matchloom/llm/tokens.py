"""Token ids of whole texts by a public word-level BPE file.

White space is dropped by that vocabulary's own splitter and no merge crosses
it, so the ids of a text are those of its white-space separated chunks in
order. Chunks repeat heavily, so each Python worker keeps a bounded cache from
chunk to ids and hands only unseen chunks to the ``tokenizers`` library. Plain
punctuation behind a word is a run of its own, so a chunk that is a word with
such a tail is put together from both and takes no place in the cache.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker's cache may hold, and characters above which a chunk is never kept.
CACHE_CHUNKS, LONG_CHUNK = 320_000, 64
#: Words that the library gets at once.
LINE_WORDS = 64
#: Bytes of text that are taken at once.
SLICE_BYTES = 8 << 20
_TAIL = ".,;:!?"
_encoders: dict[str, ChunkEncoder] = {}


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of rows of at most ``limit`` bytes, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    start, n = 0, len(ends)
    while start < n:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, end
        start = end


class ChunkEncoder:
    """Ids of texts by chunks of white-space separated text."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        spec = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": None}
        spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}
        self.words = Tokenizer.from_str(json.dumps(spec))  # merges only, for what is known to be words
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.words.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.to_chars = bytes_to_unicode()
        self.cache: dict[str, bytes] = {}  # used of late
        self.older: dict[str, bytes] = {}  # used before that, dropped when the cache is full again

    def _plain(self, word: str) -> str | None:
        """The vocabulary's spelling of a chunk that is one word of Latin letters, else None."""
        if not word.isalpha():
            return None
        if word.isascii():
            return word.lower()
        if max(word) >= "\u0250" or not unicodedata.is_normalized("NFC", word):
            return None
        word = word.lower()
        return word.encode().decode("latin-1").translate(self.to_chars) if word.isalpha() else None

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Unseen chunks with their ids from the library."""
        words, spelled, rest = [], [], []
        for c in chunks:
            if (w := c.lower() if c.isascii() and c.isalpha() else self._plain(c)) is None:
                rest.append(c)
            else:
                words.append(c)
                spelled.append(w)
        out = dict(zip(words, self._spelled(spelled), strict=True))
        for c, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[c] = array("I", found.ids).tobytes()
        return out

    def _spelled(self, words: list[str]) -> list[bytes]:
        """Ids of spelled words, many to a call: the last token of each, and no other, has the vocabulary's suffix."""
        lines = [" ".join(words[k:k + LINE_WORDS]) for k in range(0, len(words), LINE_WORDS)]
        raw = b"".join([array("I", found.ids) for found in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        ends = [0, *(4 * np.flatnonzero(self.last[np.frombuffer(raw, np.uint32)]) + 4).tolist()]
        if len(ends) != len(words) + 1 or ends[-1] != len(raw):  # a vocabulary without the suffix, or that lacks a character
            return [array("I", found.ids).tobytes() for found in self.words.encode_batch_fast(words, add_special_tokens=False)]
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as they are, by the cache of two generations."""
        if len(self.cache) > CACHE_CHUNKS // 2:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        found = list(map(cache.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        unseen = {}
        for k in missing:
            c = chunks[k]
            if c in older:
                cache[c] = older[c]
            else:
                unseen[c] = None
        if unseen:
            unseen = self._learn(list(unseen))
            cache.update({c: ids for c, ids in unseen.items() if len(c) <= LONG_CHUNK})
        for k in missing:
            c = chunks[k]
            found[k] = unseen[c] if c in unseen else cache[c]
        return found

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        cores = [core if (core := c.rstrip(_TAIL)).isalpha() else c for c in chunks]
        found = self._known(cores)
        tailed = [k for k, (c, core) in enumerate(zip(chunks, cores, strict=True)) if core is not c]
        tails = [chunks[k][len(cores[k]):] for k in tailed]
        own = list(dict.fromkeys(tails))
        own = dict(zip(own, self._known(own), strict=True))
        for k, tail in zip(tailed, tails, strict=True):
            found[k] += own[tail]
        return found

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Texts in lower case, so that equal chunks meet; as they are where that might spell a special token, which the library finds before it folds."""
        lower = pc.ascii_lower(texts)
        for token in self.special:
            spelled = pc.match_substring(lower, token.lower())
            if pc.any(spelled).as_py():
                lower = pc.if_else(spelled, texts, lower)
        return lower

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one row, offsets of each text in it)."""
        lists = pc.ascii_split_whitespace(self._lowered(texts))
        coded = lists.flatten().dictionary_encode()
        found = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = np.asarray(coded.indices)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), np.uint32)
        ends = np.concatenate([[0], np.cumsum(size[which])])
        place = np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], size[which])
        offsets = np.asarray(lists.offsets)
        return ids[place], ends[offsets - offsets[0]]


def bytes_to_unicode() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
