"""Vectorised 64-bit hashing of words and of runs of words over whole Arrow batches.

A word is read eight bytes at a time; each piece goes through a mixing step that depends on all pieces before it, so a
word's hash is a chain, as of any block hash, and not a sum or a polynomial whose terms could cancel. Runs of words are
hashed as trees: halves of 1, 2, 4, ... words, mixed at each level. No Python object is made per word.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Words over so many bytes are hashed one at a time.
_LONG = 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _ODD2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word. ``offsets`` are the n+1 byte offsets of the rows in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    solid = ~_SPACE[data[lo:hi]]
    if not len(solid):
        return (np.zeros(0, np.int64),) * 3
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > lo) & (offsets < hi)] - lo
    first[inner] |= solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first) + lo, np.flatnonzero(last) + 1 + lo
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of its bytes with A-Z in lower case if ``lower``."""
    out = np.empty(len(starts), _U)
    if not len(starts):
        return out
    lo, hi = int(starts[0]), int(ends[-1])
    padded = np.zeros(hi - lo + 8, np.uint8)
    padded[: hi - lo] = _LOWER[data[lo:hi]] if lower else data[lo:hi]
    eight = np.ndarray((hi - lo + 1,), "<u8", padded, strides=(1,))
    at, left = starts - lo, ends - starts
    state = mix(left.astype(_U) * _ODD + _ODD2)
    pick = None  # of the words that go on; all at first
    while len(at):
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        state = mix((state ^ piece) * _ODD + _ODD2)
        on = left > 8
        done = ~on
        if pick is None:
            out[done], pick = state[done], np.flatnonzero(on)
        else:
            out[pick[done]], pick = state[done], pick[on]
        at, left, state = at[on] + 8, left[on] - 8, state[on]
        if len(at) and int(left.max()) > _LONG:
            long = np.flatnonzero(left > _LONG)
            for i in pick[long]:
                raw = padded[starts[i] - lo : ends[i] - lo].tobytes()
                out[i] = _U(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))
            rest = left <= _LONG
            at, left, state, pick = at[rest], left[rest], state[rest], pick[rest]
    return out


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    level, span, out, have = words, 1, None, 0
    while True:
        if k & span:  # this level's trees are a part of the run, after the smaller parts
            part = level[have : have + n]
            out = mix(part + _ODD) if out is None else mix(out * _ODD ^ (part + _ODD2))
            have += span
        if have == k:
            return out
        level = mix(level[: len(level) - span] * _ODD ^ (level[span:] + _ODD2))
        span *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours (len(x) - w + 1 of them), by doubling."""
    if len(x) < w:
        return x[:0]
    have, span = x, 1
    while span * 2 <= w:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    n = len(x) - w + 1
    return np.minimum(have[:n], have[w - span : w - span + n])


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~x, w)
