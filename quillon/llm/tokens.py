"""Token ids of whole texts by a public tokenizer file, with a bounded cache of already encoded pieces.

A byte-level BPE pre-tokenizer never joins a character that is not white space to a space after it. So a text may be cut
before every space that follows such a character, and the ids of the parts, encoded one by one, are the ids of the text.
Most parts recur: numpy finds and hashes all parts of a batch at once, the library encodes those not met before, and the
ids are gathered from a pool. Parts are told apart by 64-bit hashes within one worker's cache of at most CACHE_PARTS.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from quillon.llm.shingles import span_hashes, string_buffers

#: Parts that a worker remembers at once, and the longest part (in bytes) that is remembered.
CACHE_PARTS, CACHE_BYTES = 1_000_000, 64

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def cut_places(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where parts begin. All are places where the pre-tokenizer cuts whatever stands around them:

    a row's first byte; a space or line feed after a character that is surely not white space; what follows a single line
    feed and is surely not white space; an ASCII mark after an ASCII letter.
    """
    n = len(raw)
    begins = np.zeros(n + 1, dtype=bool)
    begins[1:n] = _MARK[raw[1:]] & _LETTER[raw[:-1]]
    blank = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    blank = blank[blank > 0]
    before = raw[blank - 1]
    keep = ~_ASCII_SPACE[before]
    wide = np.flatnonzero(keep & (before >= 0x80))
    if len(wide):
        # U+0085 and U+00A0 begin with C2; all other wide spaces have three bytes beginning with E1, E2 or E3
        i = blank[wide]
        keep[wide] = ~((raw[np.maximum(i - 2, 0)] == 0xC2) | ((raw[np.maximum(i - 3, 0)] >= 0xE1) & (raw[np.maximum(i - 3, 0)] <= 0xE3)))
    blank = blank[keep]
    begins[blank] = True
    feed = blank[(raw[blank] == 0x0A) & (blank + 1 < n)] + 1
    after = raw[feed]
    starts = np.zeros(n + 1, dtype=bool)
    starts[at] = True
    begins[feed[~_ASCII_SPACE[after] & ~((after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))) & ~starts[feed - 1]]] = True
    begins[at[:-1]] = True
    begins[n] = False
    return np.flatnonzero(begins)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: Bytes that each id stands for: a byte-level vocabulary writes one character for one byte.
        self.width = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.start, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.parts = 0
        self._freeze()

    def _freeze(self) -> None:
        """Move what the dict knows to an index that is searched for a whole batch at once; the last number stands for unknown."""
        keys, numbers = np.fromiter(self.known.keys(), dtype=np.uint64), np.fromiter(self.known.values(), dtype=np.int64)
        if not self.parts:
            self.frozen, self.frozen_number = pd.Index(keys), np.append(numbers, -1)
        else:
            self.frozen, self.frozen_number = pd.Index(np.concatenate([self.frozen.to_numpy(), keys])), np.concatenate([self.frozen_number[:-1], numbers, [-1]])
        self.known = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Append parts (their ids, one after the other) to the pool; returns their numbers."""
        n, m = len(counts), len(ids)
        while self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.parts + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.pool[self.used : self.used + m] = ids
        ends = np.cumsum(counts)
        self.start[self.parts : self.parts + n] = self.used + ends - counts
        self.count[self.parts : self.parts + n] = counts
        self.used += m
        self.parts += n
        return np.arange(self.parts - n, self.parts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and where each row's ids begin (rows + 1 places). Nulls count as empty."""
        at, raw = string_buffers(column)
        if not len(raw):
            return np.zeros(0, dtype="<u4"), np.zeros(len(at), dtype=np.int64)
        if self.parts > CACHE_PARTS or self.used > 16 * CACHE_PARTS:
            self._forget()
        elif len(self.known) > max(20_000, len(self.frozen) // 4):
            self._freeze()
        first = cut_places(raw, at)
        last = np.append(first[1:], len(raw))
        hashes = span_hashes(raw, first, last)
        codes, unique = pd.factorize(hashes)
        get = self.known.get
        number = self.frozen_number[self.frozen.get_indexer(unique)]
        recent = np.flatnonzero(number < 0)
        number[recent] = [get(h, -1) for h in unique[recent].tolist()]
        missing = np.flatnonzero(number < 0)
        if len(missing):
            where = np.empty(len(unique), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            a, b = first[where[missing]], last[where[missing]]
            text = raw.tobytes()
            # a part that begins with a space where cut_places cuts within a row can stand after any other such part:
            # they are encoded as one text and told apart by width. The last of a row may end in white space.
            end = np.zeros(len(raw) + 1, dtype=bool)
            end[at] = True
            joined = (raw[a] == 0x20) & ~end[a] & ~end[b] & ~_ASCII_SPACE[raw[b - 1]]
            group, single = missing[joined], missing[~joined]
            for k in range(0, len(group), 4096):
                x, y = a[joined][k : k + 4096], b[joined][k : k + 4096]
                ids = self._ids(b"".join([text[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]).decode())
                cuts = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(y - x)) + 1
                number[group[k : k + 4096]] = self._learn(ids, np.diff(cuts, prepend=0))
            for k, i, j in zip(single.tolist(), a[~joined].tolist(), b[~joined].tolist(), strict=True):
                ids = self._ids(text[i:j].decode())
                number[k] = self._learn(ids, np.array([len(ids)]))[0]
            short = b - a <= CACHE_BYTES
            self.known.update(zip(unique[missing[short]].tolist(), number[missing[short]].tolist(), strict=True))
        part = number[codes]
        counts = self.count[part]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.start[part] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(first, at)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
