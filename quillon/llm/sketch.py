"""Fast similarity sketching: rounds of hashed bin placement that fill every coordinate.

In round i < t each element goes to one bin, chosen by a hash of its own; a bin takes the least value of the first round
that reaches it. In round t + b every element goes to bin b, so that no bin can stay empty. Each coordinate agrees for two
sets with a probability of their Jaccard similarity, and as a round deals elements without replacement the number of
agreements concentrates at least as well as with independent coordinates. A set of n elements needs about
t * ln(t) / n rounds of n steps each instead of t * n steps.
"""

from __future__ import annotations

import numpy as np

from quillon.llm.shingles import mix

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def _seed(i: int) -> np.uint64:
    return _U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A t-place sketch for each set, as rows; rows of empty sets hold the greatest value and match nothing by contract of the caller."""
    out = np.full(len(sets) * t, _EMPTY, dtype=_U)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    live = np.flatnonzero(sizes)
    with np.errstate(over="ignore"):
        elements = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, dtype=_U)
        owner = np.repeat(live, sizes[live])
        for i in range(t):
            if not len(live):
                break
            x = mix(elements ^ _seed(i))
            at = owner * t + (x % _U(t)).astype(np.int64)
            value = mix(x + _seed(t + i)) >> _U(1)
            free = out[at] == _EMPTY
            np.minimum.at(out, at[free], value[free])
            full = (out.reshape(-1, t)[live] != _EMPTY).all(axis=1)
            if full.any():
                keep = np.zeros(len(sets), dtype=bool)
                live = live[~full]
                keep[live] = True
                held = keep[owner]
                elements, owner = elements[held], owner[held]
        for i in live:
            row = out[i * t : (i + 1) * t]
            for b in np.flatnonzero(row == _EMPTY):
                row[b] = (mix(sets[i] ^ _seed(2 * t + int(b))) >> _U(1)).min()
    return out.reshape(-1, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of `rows` places; the band's number is part of the key."""
    n, t = sketch.shape
    with np.errstate(over="ignore"):
        cut = sketch[:, : t // rows * rows].reshape(n, t // rows, rows)
        key = np.zeros(cut.shape[:2], dtype=_U) + np.arange(cut.shape[1], dtype=_U)
        for k in range(rows):
            key = mix(key * _U(0xD6E8FEB86659FD93) + cut[:, :, k])
    return key.view(np.int64)
