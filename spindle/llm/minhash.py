"""Near-duplicate documents by HyperMinHash sketches.

Each document's distinct five-word shingles fall into ``BUCKETS`` buckets; a bucket keeps its least
hash, compressed to a leading-zero count and ``MANTISSA`` mantissa bits. Bands of registers make
candidates; the collision-corrected estimate drops the unlikely ones (by a margin of ``SIGMAS``
standard errors: of pairs at the limit some 3e-7 go); the rest is confirmed on the full shingle sets.

At 32 bands of 4 registers a pair at the limit of 0.75 is missed with probability 5e-6, and
with less the more alike or the smaller its sets are. Documents of equal sets form one class first, so
thousands of copies are one row; large groups of near copies are joined through hubs (components.py).

Nulls and texts without words have an empty set and no link: each is its own component. Every row comes
back, repeated ones too; rows of one doc_id but different texts are different nodes. A row without
doc_id is linked with nothing and is kept, with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bounded, discard, ids_and_texts, let_go, materialise, text_bytes, unused
from .components import linked_groups

WORDS, PERCENT = 5, 75
BANDS, ROWS, MANTISSA, SIGMAS = 32, 4, 10, 5.0
BUCKETS = BANDS * ROWS
#: Words of 64 parity bits of a set; sizes of sets from which they say little, so that registers are compared too.
PARITY, LARGE = 16, 1000
_SHIFT = 64 - int(np.log2(BUCKETS))


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle hash) of a text column."""
    data, offsets = text_bytes(column)
    data, offsets = np.frombuffer(data, np.uint8), np.asarray(offsets, np.int64)
    starts, ends, row = hashing.find_words(data, offsets)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = hashing.hash_words(data, starts, ends, lower=True)
    runs = hashing.hash_runs(w, words)
    whole = row[: len(runs)] == row[words - 1 :] if len(runs) else np.zeros(0, bool)
    rows, sets = [row[: len(runs)][whole]], [runs[whole]]
    count = np.bincount(row, minlength=len(column))
    first = np.searchsorted(row, np.arange(len(column)))
    for n in range(1, words):  # shorter texts: the whole sequence is the one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            sets.append(hashing.mix(hashing.hash_runs(w, n)[first[short]] + np.uint64(n)))
    rows, sets = np.concatenate(rows), np.concatenate(sets)
    order = np.lexsort((sets, rows))
    rows, sets = rows[order], sets[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (sets[1:] != sets[:-1])
    return rows[new], sets[new]


def registers(rows: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) uint16: 0 for an empty bucket, else 1 + leading zeros and mantissa of its least hash."""
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(rows):
        return out
    cell = rows * BUCKETS + (sets >> np.uint64(_SHIFT)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # sorted by row and hash: a cell's first is its least
    cell, least = cell[first], sets[first] & np.uint64((1 << _SHIFT) - 1)
    _, exponent = np.frexp((least >> np.uint64(4)).astype(np.float64))
    bits = np.maximum(exponent, MANTISSA + 1)  # of least >> 4, exact below 2**53
    zeros = np.minimum(_SHIFT - 4 - bits, 62)
    mantissa = ((least >> np.uint64(4)) >> (bits - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out.reshape(-1)[cell] = 1 + (zeros << MANTISSA) + mantissa.astype(np.int64)
    return out


def parities(rows: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY) int64: bit by bit, whether an odd number of a set's hashes fall on it. Where two sets differ in a bit, an element of
    only one of them falls on it, so they have at least as many of those as bits that differ."""
    bits = 64 * PARITY
    count = np.bincount(rows * bits + (hashing.mix(sets) % np.uint64(bits)).astype(np.int64), minlength=n * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<i8").astype(np.int64)


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that holds something."""
    parts = regs.reshape(len(regs), BANDS, ROWS)
    row, band = np.nonzero(parts.any(axis=2))
    packed = parts[row, band].astype(np.uint64) @ (np.uint64(1) << np.arange(0, 16 * ROWS, 16, dtype=np.uint64))
    return row, hashing.mix(hashing.mix(packed) + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Buckets in which two unrelated sets of n and m elements agree by chance after compression."""
    a, b = n[:, None] / BUCKETS, m[:, None] / BUCKETS
    level = np.arange(0, 40)[None, :]
    lo, hi = 2.0 ** -(level + 1), 2.0**-level
    cell = lo / (1 << MANTISSA)
    s = a + b
    return BUCKETS * (a * b / s * cell * (np.exp(-s * lo) - np.exp(-s * hi))).sum(1)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of register pairs, and the buckets it rests on."""
    used = ((x > 0) | (y > 0)).sum(1)
    same = ((x == y) & (x > 0)).sum(1)
    return np.clip((same - expected_collisions(n, m)) / np.maximum(used, 1), 0, 1), used


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        n = len(batch)
        rows, sets = shingle_sets(batch.column(1))
        size = np.bincount(rows, minlength=n)
        regs = registers(rows, sets, n)
        edge = np.concatenate([[0], np.cumsum(size)])
        f1, f2 = _fingerprint(sets, edge, 0), _fingerprint(sets, edge, 1)
        row, key = band_keys(regs)
        bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32), pa.array(key.view(np.int64)))
        raw = regs.tobytes()
        packed = pa.array([raw[i : i + 2 * BUCKETS] for i in range(0, len(raw), 2 * BUCKETS)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(f1), pa.array(f2), bands, packed], names=["doc_id", "n_shingles", "f1", "f2", "bands", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128-bit fingerprint of the set (f1, f2), bands, packed registers."""
    return ids_and_texts(docs).mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, regs binary")


def _fingerprint(sets: np.ndarray, edge: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each set: the wrapping sum of its mixed hashes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix(sets + np.uint64(seed)))])
    return (total[edge[1:]] - total[edge[:-1]]).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        rows, sets = shingle_sets(batch.column(1))
        edge = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(batch)))]).astype(np.int32)
        size = np.diff(edge)
        odd = pa.FixedSizeListArray.from_arrays(pa.array(parities(rows, sets, len(batch)).reshape(-1)), PARITY).cast(pa.list_(pa.int64()))
        # filled registers of large sets as numbers that are equal where bucket and value are
        regs = registers(rows, sets, len(batch))
        regs[size < LARGE] = 0
        row, bucket = np.nonzero(regs)
        cells = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32), pa.array(bucket.astype(np.int32) << 16 | regs[row, bucket].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(_fingerprint(sets, edge, 0)), pa.ListArray.from_arrays(edge, pa.array(sets.view(np.int64))), pa.array(size.astype(np.int64)), odd, cells], names=["id", "shingles", "n", "odd", "cells"])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 4))
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (3, 5))
            j, used = estimate(x, y, n, m)
            limit = percent / 100
            keep = j >= limit - SIGMAS * np.sqrt(limit * (1 - limit) / np.maximum(used, 1))
            keep &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)  # else the sizes alone rule the pair out
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``; n_links: links of its class that were tested and
    confirmed; pairs inside a group that is already joined are not tested, so it is not the number of all links."""
    all_ = materialise(sketches(docs), "sketches")
    full = all_.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "f1", "f2"]
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    reps = materialise(full.join(classes.select(*key, "rep"), key).where("doc_id = rep").select(F.col("f1").alias("id"), "rep", "n_shingles", "bands", "regs").distinct(), "reps")
    banded = reps.select(F.explode("bands").alias("key"), "id")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialise(banded.join(shared, "key"), "members")
    del banded, shared
    let_go(docs.sparkSession)
    involved = reps.join(members.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = ids_and_texts(docs).join(involved, "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets, "id long, shingles array<long>, n long, odd array<long>, cells array<int>"), "sets")
    sketch, full_sets = reps.select("id", "regs", "n_shingles"), sets.select("id", "shingles")

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select(*[F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in of.columns])

    def confirm(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(side(sketch, "a"), "a").join(side(sketch, "b"), "b").select("a", "b", "regs_a", "n_shingles_a", "regs_b", "n_shingles_b")
        likely = likely.mapInArrow(_likely(percent), "a long, b long")
        same = F.size(F.array_intersect("shingles_a", "shingles_b"))
        union = F.size("shingles_a") + F.size("shingles_b") - F.col("same")
        both = likely.join(side(full_sets, "a"), "a").join(side(full_sets, "b"), "b")
        return both.withColumn("same", same).where(100 * F.col("same") >= percent * union).select("a", "b").distinct()

    def bound(ids: DataFrame) -> DataFrame:
        return sets.select("id", "n", "odd", "cells").join(ids, "id", "left_semi").dropDuplicates(["id"])

    # elements of only one of two linked sets are a small share of both sets' sizes, and no fewer than the parity bits that differ
    differ = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(PARITY))
    possible = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and (100 + {percent}) * ({differ}) <= (100 - {percent}) * (x.n + y.n)"
    # and the estimate's margin, on registers as (bucket, value): the number that agree can't be far below the limit's share
    used = "greatest(size(x.cells), size(y.cells))"
    margin = f"size(array_intersect(x.cells, y.cells)) >= {percent / 100} * {used} - {SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100))} * sqrt({used})"
    possible += f" and (least(x.n, y.n) < {LARGE} or {margin})"
    groups, links = linked_groups(members, confirm, bound, possible)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = classes.withColumn("id", F.col("f1")).join(groups, "id", "left").join(degree, "id", "left")
    smallest = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("smallest"))
    classes = classes.join(smallest, "component", "left").select(*key, F.coalesce("smallest", "rep").alias("class"), "n_links")
    found = all_.select("doc_id", *key).join(classes, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = materialise(out, "near")
    discard(all_, reps, sets, groups, links)
    return out


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is kept: of each connected group the smallest id. Rows of one kept id and one text
    become one. Rows without doc_id all stay, repeated ones too."""
    near = near_duplicates(docs, percent)
    verdict = materialise(near.where("doc_id is not null and kept").select("doc_id"), "kept")
    discard(near)
    (name,) = unused(docs, "kept_id")
    ids = verdict.select(F.col("doc_id").alias(name)).distinct()
    out = docs.join(ids, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    if ids.count() < verdict.count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id is null"))
