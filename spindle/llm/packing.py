"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous steps.

A document's ids and the end id are cut into pieces only beyond the capacity. Pieces are range-sorted by (length, doc_id,
piece), and each gets its rank among the pieces of its length. All that best fit decides depends on lengths alone, so
documents and gaps are matched class by class: a superstep takes the longest length left, sweeps the sorted gap sizes for the
successor (the least gap that holds it), gives the gaps of that size to the documents in rank order, updates the gaps,
and repeats; what finds no gap opens new sequences. There are at most ``capacity`` lengths and gaps, whatever the
corpus; the sweep over these classes runs on the driver, and its outcome, blocks of (length, ranks) against (sequences, offset), is
applied to all pieces where they are. Ranks come from per-partition counts, so a length that a third of all
rows share is ranked by many tasks.

Null texts are empty: one piece that is the end id. Every row is packed, repeated rows and null doc_ids too.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicon
from .common import bounded, discard, ids_and_texts, materialise, ship, shipped, shuffle_width
from .memo import Memo

CAPACITY, END, WORDS = 2048, 0, 600_000
#: Bytes of texts that are encoded together: a word that several of them have is looked up once, and new words are merged in larger blocks.
BATCH = 12 << 20


class Ids:
    """word -> its ids as little-endian 32-bit numbers, for the words met so far."""

    def __init__(self, path: str):
        self.lexicon = lexicon.load(path)
        self.known = Memo(WORDS)

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [lexicon.split_words(t) for t in texts]
        ids = self.known.fill(set().union(*words), self.lexicon.pack)
        return [b"".join(map(ids, w)) for w in words]


@lru_cache(maxsize=4)
def _ids(path: str) -> Ids:
    return Ids(path)


def _cutter(name: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = _ids(shipped(name)), np.array([END], "<u4").tobytes(), 4 * capacity
        for batch in bounded(batches, 1, BATCH):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, raw in zip(batch.column(0).to_pylist(), ids.encode([t or "" for t in batch.column(1).to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    doc.append(d), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    return ids_and_texts(docs).mapInArrow(_cutter(ship(docs.sparkSession, vocabulary), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts`` pieces by length, as blocks (length, first rank, pieces, first sequence, offset).

    A block's pieces, in rank order, go one each to consecutive sequences at the same offset.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size -> blocks (first sequence, sequences)
    sizes: list[int] = []
    opened = 0

    def place(length: int, rank: int, first: int, n: int, gap: int, each: int) -> int:
        for k in range(each):
            plan.append((length, rank, n, first, capacity - gap + k * length))
            rank += n
        left = gap - each * length
        if left:
            if left not in gaps:
                gaps[left] = []
                insort(sizes, left)
            gaps[left].append((first, n))
        return rank

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first = capacity, opened
                n = -(-(total - rank) // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, (total - rank) // each)
            if full:
                rank = place(length, rank, first, full, gap, each)
            if full < n:
                rest = total - rank
                if rest:
                    rank = place(length, rank, first + full, 1, gap, rest)
                    full += 1
                if full < n:
                    if gap not in gaps:
                        gaps[gap] = []
                        insort(sizes, gap)
                    gaps[gap].append((first + full, n - full))
    return plan


def _placer(ranks: dict[tuple[int, int], int], plan: list[tuple[int, int, int, int, int]]):
    plan = sorted(plan)
    table = np.array(plan, np.int64).reshape(-1, 5).T
    span = int((table[1] + table[2]).max()) + 1 if len(plan) else 1
    starts = table[0] * span + table[1]
    keys = np.array(sorted(ranks), np.int64).reshape(-1, 2)
    wide = int(keys[:, 1].max()) + 1 if len(keys) else 1
    coded, base = keys[:, 0] * wide + keys[:, 1], np.array([ranks[k] for k in sorted(ranks)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, length = batch.column("at").to_numpy(), batch.column("length").to_numpy()
            rank = at + base[np.searchsorted(coded, (at >> 33) * wide + length)]
            k = np.searchsorted(starts, length * span + rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table[3][k] + rank - table[1][k]), pa.array(table[4][k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` of pieces() with sequence_id and offset."""
    spark = items.sparkSession
    # range partitioning reads its input twice (a sample first): written, the texts are encoded once
    items = materialise(items, "items")
    ordered = items.repartitionByRange(shuffle_width(spark), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "pieces")
    discard(items)
    # a row for each partition and length in it: range partitions share few lengths, so partitions + capacity rows at most
    part = F.shiftright("at", 33).alias("part")
    rows = ordered.groupBy(part, "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    counts: dict[int, int] = {}
    ranks = {}
    for r in sorted(rows):
        ranks[(r["part"], r["length"])] = counts.get(r["length"], 0) - r["first"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    place = _placer(ranks, supersteps(counts, capacity))
    return ordered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return best_fit(pieces(docs, vocabulary, capacity), capacity)
