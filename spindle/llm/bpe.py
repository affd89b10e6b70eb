"""Byte-pair encoding of many short words at once, from a tokenizer file's vocabulary and merges.

Each word is a row of a contiguous rank array: its parts in order, and beside each part the rank of the merge
with its right neighbour. The rows' least ranks are found, the boundary there is deleted, and the
ranks of the two neighbours are refreshed, for all rows of a block together, until no row has a merge left. Words
over ``LONG`` bytes go through a heap instead, in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LONG = 128
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    return [other.get(b, chr(b)) for b in range(256)]


class Merges:
    """Tables of one tokenizer file: ids of single bytes, pair -> (rank, merged id), id -> bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        ids = np.array([vocab[a + b] for a, b in pairs], np.int64)
        bits = int(np.ceil(np.log2(len(keys)))) + 3
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_value = np.full(1 << bits, _NONE, np.int64)
        # open addressing, filled a round at a time: who loses its slot tries the next
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] < 0
            self.slot_key[at[left[free]]] = keys[left[free]]
            won = self.slot_key[at[left]] == keys[left]
            self.slot_value[at[left[won]]] = (left[won] << 20) | ids[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask
        self.by_pair = dict(zip(keys.tolist(), zip(range(len(keys)), ids.tolist())))
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t.removesuffix(suffix)) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, ``_NONE`` for no merge."""
        keys = (left << 20) | right
        at = self._home(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_value[at], _NONE)
        left_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(left_):
            at[left_] = (at[left_] + 1) & self.mask
            found = self.slot_key[at[left_]]
            hit = found == keys[left_]
            out[left_[hit]] = self.slot_value[at[left_[hit]]]
            left_ = left_[~hit & (found >= 0)]
        return out

    def blocks(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
        """(positions in ``words``, their ids one after the other, n+1 edges), a block of similar lengths at a time."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        lo = 0
        for hi in (1, 3, 5, 7, 9, 11, 13, 16, 20, 26, 36, 64, LONG):
            pick = np.flatnonzero((length > lo) & (length <= hi))
            lo = hi
            for k in range(0, len(pick), 32768):
                part = pick[k : k + 32768]
                flat, edge = self._block([words[i] for i in part], length[part], hi)
                yield part.tolist(), flat, edge
        for i in np.flatnonzero((length > LONG) | (length == 0)).tolist():
            ids = np.array(self._long(words[i]), np.int64)
            yield [i], ids, [0, len(ids)]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (of its bytes; no white space rules)."""
        out: list = [None] * len(words)
        for at, flat, edge in self.blocks(words):
            ids = flat.tolist()
            for i, a, b in zip(at, edge, edge[1:]):
                out[i] = ids[a:b]
        return out

    def count(self, words: list[bytes]) -> list[int]:
        """The number of ids of each word."""
        out = np.zeros(len(words), np.int64)
        for at, _, edge in self.blocks(words):
            out[at] = np.diff(edge)
        return out.tolist()

    def pack(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out: list = [b""] * len(words)
        for at, flat, edge in self.blocks(words):
            raw = flat.astype("<u4").tobytes()
            for i, a, b in zip(at, edge, edge[1:]):
                out[i] = raw[4 * a : 4 * b]
        return out

    def _block(self, words: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, list[int]]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        rows = np.arange(n)
        ids[rows, length - 1] = self.final[raw[rows, length - 1]]
        size = length.copy()
        ranks = np.full((n, width), _NONE, np.int64)
        if width > 1:
            ranks[:, :-1] = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            ranks[np.arange(width)[None, :] >= (size - 1)[:, None]] = _NONE
        done = np.zeros((n, width), np.int64)
        live = rows
        column = np.arange(width)[None, :]
        while len(live):
            at = ranks.argmin(1)
            r = np.arange(len(live))
            best = ranks[r, at]
            over = best >= _NONE
            if over.any():
                done[live[over]] = ids[over]
                go = ~over
                live, ids, ranks, size_, at, best = live[go], ids[go], ranks[go], size[live[go]], at[go], best[go]
                r = np.arange(len(live))
                if not len(live):
                    break
            else:
                size_ = size[live]
            ids[r, at] = best & ((1 << 20) - 1)
            src = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, src, 1)
            src = np.minimum(column + (column >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, src, 1)
            size_ = size_ - 1
            size[live] = size_
            for shift in (-1, 0):
                left = at + shift
                ok = np.flatnonzero((left >= 0) & (left < size_ - 1))
                if len(ok):
                    ranks[ok, left[ok]] = self.look_up(ids[ok, left[ok]], ids[ok, left[ok] + 1])
            end = np.flatnonzero(at >= size_ - 1)
            ranks[end, np.maximum(size_[end] - 1, 0)] = _NONE
        keep = column < size[:, None]
        return done[keep], np.concatenate([[0], np.cumsum(size)]).tolist()

    def _long(self, word: bytes) -> list[int]:
        if not word:
            return []
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pairs = self.by_pair
        heap = [(*p, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (p := pairs.get((ids[i] << 20) | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if p := pairs.get((merged << 20) | ids[k]):
                    heapq.heappush(heap, (*p, i, merged, ids[k]))
            if (h := before[i]) >= 0 and (p := pairs.get((ids[h] << 20) | merged)):
                heapq.heappush(heap, (*p, h, ids[h], merged))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)
