"""Repeated word sequences by relative Lempel-Ziv parsing against the whole corpus.

The corpus itself, in blocks, is the reference. Its index holds every 35-word phrase that a block shares
with another place. Each document is factored greedily against that index: at a word where an
indexed phrase starts, a factor begins and is extended as long as the phrase that ends one word further is indexed
too; other words are literals. A factor has ``WINDOW`` words at least by construction; its words are removed.

Two rounds keep the index small. First, blocks send only the anchors of their documents (minimizers of 16-word
runs; any 35 words in a row hold one), each hash once a block however often it occurs; then, only the phrases whose
own anchor is shared. Rows that travel are packed arrays of (bucket, block), so a passage that a third
of all documents hold is one entry a block. Each block looks at its own texts again to parse them; texts
move once, to their block.

Null and empty texts have no words and nothing to remove. Every row comes back, repeated rows included (they
are copies of one another, so long ones are removed entirely). Null doc_ids are rows like any other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import ids_and_texts, shuffle_width, text_bytes

WINDOW, ANCHOR = 35, 16
#: Bytes of text a block and a bucket of the index are meant for. Their numbers follow the corpus, not the cluster's width, so that
#: the packed rows between them (one for each block and bucket that meet) stay few and large.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
_PACKED = "bucket long, block long, hashes binary"
_BACK = "block long, hashes binary"


class _Parsed:
    """A block's texts as word hashes, with where its phrases and anchors are."""

    def __init__(self, texts: pa.Array, window: int):
        data, offsets = text_bytes(texts)
        self.data, self.offsets = np.frombuffer(data, np.uint8), np.asarray(offsets, np.int64)
        starts, ends, self.row = hashing.find_words(self.data, self.offsets)
        words = hashing.hash_words(self.data, starts, ends)
        self.window = window
        n = len(words) - window + 1
        self.phrases = hashing.hash_runs(words, window)
        self.inside = self.row[: max(n, 0)] == self.row[window - 1 :] if n > 0 else np.zeros(0, bool)
        size = min(ANCHOR, window)
        self.width = window - size + 1
        grams = hashing.hash_runs(words, size) | np.uint64(1)
        self.least = least = np.where(self.inside, hashing.sliding_min(grams, self.width), np.uint64(0))[: max(n, 0)]
        pad = np.zeros(self.width - 1, np.uint64)
        greatest = hashing.sliding_max(np.concatenate([pad, least, pad]), self.width)[: len(grams)] if n > 0 else grams[:0]
        grams = grams[: len(greatest)]
        self.at = np.flatnonzero(grams == greatest)
        self.anchors = grams[self.at]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the phrases whose own anchor is in ``shared`` (sorted)."""
        if not len(shared):
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.inside & _among(self.least, shared))


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1) if len(table) else None
    return table[at] == x if at is not None else np.zeros(len(x), bool)


def _packed(hashes: np.ndarray, block: int, buckets: int) -> pa.Table:
    """One row a bucket; a hash is in it twice if the block holds it more than once."""
    values, counts = np.unique(hashes, return_counts=True)
    values = np.repeat(values, np.minimum(counts, 2))
    bucket = (values >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edge = [0, *cuts.tolist(), len(values)] if len(values) else [0]
    raw = values.tobytes()
    return pa.table({"bucket": pa.array(bucket[edge[:-1]].astype(np.int64)), "block": pa.array([block] * (len(edge) - 1), pa.int64()), "hashes": pa.array([raw[8 * i : 8 * j] for i, j in zip(edge, edge[1:])], pa.binary())})


def _shared(buckets: pa.Table) -> pa.Table:
    """Of one bucket, the hashes held at two places or more, sent back to each block that has them."""
    raw = buckets["hashes"].to_pylist()
    h = np.frombuffer(b"".join(raw), np.uint64)
    block = np.repeat(buckets["block"].to_numpy(), [len(x) // 8 for x in raw])
    order = np.lexsort((block, h))
    h, block = h[order], block[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    twice = same[1:] | same[:-1]
    first = np.ones(len(h), bool)
    first[1:] = ~same[1:-1] | (block[1:] != block[:-1])
    h, block = h[twice & first], block[twice & first]
    order = np.argsort(block, kind="stable")
    h, block = h[order], block[order]
    edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(h)] if len(h) else [0]
    raw = h.tobytes()
    return pa.table({"block": pa.array(block[edge[:-1]], pa.int64()), "hashes": pa.array([raw[8 * i : 8 * j] for i, j in zip(edge, edge[1:])], pa.binary())})


def _gathered(back: pa.Table) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(back["hashes"].to_pylist()), np.uint64))


def factors(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors [first, end) of a text in whose word positions ``starts`` an indexed phrase begins.

    A factor goes on while the next word ends an indexed phrase; one that begins within or
    right at the end of the last but isn't its continuation is a factor of its own.
    """
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    first = starts[new]
    last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    return first, last + window


def _parse(window: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        texts = docs["text"].combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        parsed = _Parsed(texts, window)
        index = _gathered(back)
        begin = np.flatnonzero(parsed.inside & _among(parsed.phrases, index)) if len(index) else np.zeros(0, np.int64)
        first, end = factors(begin, window)
        depth = np.zeros(len(parsed.row) + 1, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, end, -1)
        gone = np.cumsum(depth)[:-1] > 0
        n = len(texts)
        words = np.bincount(parsed.row, minlength=n)
        removed = np.bincount(parsed.row[gone], minlength=n)
        edge = np.concatenate([[0], np.cumsum(words)])
        kept = ~gone
        raw, at = parsed.data.tobytes(), parsed.offsets
        digests = []
        for i in range(n):
            own = raw[at[i] : at[i + 1]].split()
            if removed[i]:
                own = compress(own, kept[edge[i] : edge[i + 1]].tolist())
            digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return run


def removed_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks, buckets = total // BLOCK_BYTES + 1, total // BUCKET_BYTES + 1

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        return _packed(_Parsed(table["text"].combine_chunks(), window).anchors, key[0].as_py(), buckets)

    def phrases(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not len(back) or not len(table):
            return _packed(np.zeros(0, np.uint64), 0, buckets)
        parsed = _Parsed(table["text"].combine_chunks(), window)
        return _packed(parsed.phrases[parsed.candidates(_gathered(back))], key[0].as_py(), buckets)

    own = ids_and_texts(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    own = own.repartition(width, "block")
    first = own.groupBy("block").applyInArrow(anchors, _PACKED).groupBy("bucket").applyInArrow(_shared, _BACK)
    second = own.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(phrases, _PACKED).groupBy("bucket").applyInArrow(_shared, _BACK)
    return own.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(_parse(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
