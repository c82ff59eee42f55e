"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed on Arrow string buffers with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LANES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n + 1, dtype=_U)
    out[0] = 1
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BLOCK = 1 << 16
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_UP, _DOWN = _powers(_BLOCK, _BASE), _powers(_BLOCK, _INVERSE)


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = _fold()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return at - at[0] if len(at) else np.zeros(1, dtype=np.int64), raw[at[0] : at[-1]] if len(at) else raw


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the spans [first, last) of a byte string, all at once: polynomial sums modulo 2**64 as differences of prefix sums.

    Powers repeat every _BLOCK bytes; a span that crosses a block's edge is summed on its own.
    """
    n = len(raw)
    with np.errstate(over="ignore"):
        low = raw.astype(_U) + _U(1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(low * np.resize(_UP[:_BLOCK], n), out=sums[1:])
        h = (sums[last] - sums[first]) * _DOWN[first % _BLOCK]
        for i in np.flatnonzero(first // _BLOCK != (last - 1) // _BLOCK):
            span = low[first[i] : last[i]]
            total, scale = _U(0), _U(1)
            for k in range(0, len(span), _BLOCK):
                part = span[k : k + _BLOCK]
                total += (part * _UP[: len(part)]).sum(dtype=_U) * scale
                scale *= _UP[_BLOCK]
            h[i] = total
        return mix(h ^ (last - first).astype(_U))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) and, per row, where its words begin (n + 1 places).

    A word's hash is the polynomial sum of its bytes modulo 2**64, taken as a difference of prefix sums.
    """
    at, raw = string_buffers(column)
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=_U), np.zeros(len(at), dtype=np.int64)
    space = _SPACE[raw]
    starts_row = np.zeros(n + 1, dtype=bool)
    starts_row[at] = True
    inner = ~space
    begin = inner.copy()
    begin[1:] &= space[:-1] | starts_row[1:n]
    end = inner.copy()
    end[:-1] &= space[1:] | starts_row[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = span_hashes(_LOWER[raw], first, last)
    return h, np.searchsorted(first, at)


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes; a text with fewer words gives its whole sequence, one without words nothing."""
    h, at = word_hashes(column)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        n = len(h) - words + 1
        wide = np.zeros(max(n, 0), dtype=_U)
        for k in range(words):
            if n > 0:
                wide += mix(h[k : k + n] + _U(k)) * _LANES[k % len(_LANES)]
        wide = mix(wide)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(wide[a : b - words + 1]))
            elif b > a:
                part = sum((mix(h[a + k : a + k + 1] + _U(k)) * _LANES[k % len(_LANES)] for k in range(b - a)), np.zeros(1, dtype=_U))
                out.append(mix(part + _U(b - a)))
            else:
                out.append(np.zeros(0, dtype=_U))
    return out
