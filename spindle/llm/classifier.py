"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from its characters' classes, word lengths,
repetition and hashed words; a hidden layer and gated attention, learned from document labels alone, weight the
passages, and the weighted passage representation is scored.

It is fitted on the driver on a bounded sample, the ``SAMPLE`` labelled rows outside the held-out fold with the least hashes of
their ids (a documented parameter); all rows are scored where they are, with nothing shuffled.

Null and empty texts are one empty passage, and have a score. Labels other than 0 and 1 are ignored; where an id has
several, it counts as 1 only if all are. With no usable labels every score is 0.5. Every row comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bounded, ids_and_texts, text_bytes

PASSAGE, HASHED, HIDDEN, SAMPLE, STEPS, CUT = 64, 256, 16, 3000, 250, 0.3
_SETS = (range(65, 91), range(97, 123), range(48, 58), range(128, 256), (10,), b".", b",", b"!", b"|", b"#*$%&<>", b"\"'()+-/:;=?@[]^_`{}~")
_CLASSES = np.zeros((len(_SETS), 256), np.int32)
for _k, _set in enumerate(_SETS):
    _CLASSES[_k, list(_set)] = 1
DENSE = len(_SETS) + 5


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages as rows of features, and the row of ``texts`` that each is of (sorted, none without a passage)."""
    n = len(texts)
    raw, offsets = text_bytes(texts)
    data, offsets = np.frombuffer(raw, np.uint8), np.asarray(offsets, np.int64)
    starts, ends, row = hashing.find_words(data, offsets)
    words = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
    new = place % PASSAGE == 0
    passage = np.cumsum(new) - 1
    count = int(new.sum())
    x = np.zeros((count, DENSE + HASHED), np.float32)
    if count:
        size = np.bincount(passage, minlength=count)
        first = np.flatnonzero(new)
        lo, hi = starts[first], ends[first + size - 1]
        own = data[lo[0] : hi[-1]]  # ``texts`` may be a slice of a far larger batch
        for k in range(len(_SETS)):
            total = np.concatenate([[0], np.cumsum(_CLASSES[k][own], dtype=np.int64)])
            x[:, k] = (total[hi - lo[0]] - total[lo - lo[0]]) / (hi - lo)
        length = (ends - starts).astype(np.float64)
        h = hashing.hash_words(data, starts, ends, lower=True)
        order = np.lexsort((h, passage))
        same = np.zeros(len(h), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        k = len(_SETS)
        mean = np.bincount(passage, length, count) / size
        x[:, k] = mean / 10
        x[:, k + 1] = np.sqrt(np.maximum(np.bincount(passage, length**2, count) / size - mean**2, 0)) / 10
        x[:, k + 2] = np.log1p(size) / 5
        x[:, k + 3] = 1 - np.bincount(passage[order][same], minlength=count) / size
        x[:, k + 4] = np.log1p(words[row[first]]) / 10
        bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
        x[:, DENSE:] = np.bincount(passage * HASHED + bucket, minlength=count * HASHED).reshape(count, HASHED) / size[:, None]
    owner = row[new]
    empty = np.flatnonzero(words == 0)
    if len(empty):
        owner, x = np.concatenate([owner, empty]), np.concatenate([x, np.zeros((len(empty), x.shape[1]), np.float32)])
        order = np.argsort(owner, kind="stable")
        owner, x = owner[order], x[order]
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """h = tanh(xW+b); a = softmax over a bag of w.(tanh(hV) * sigmoid(hU)); p = sigmoid(c.(sum a h) + d)."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        n = HIDDEN
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"W": r.normal(0, width**-0.5, (width, n)), "b": np.zeros(n), "V": r.normal(0, n**-0.5, (n, n)), "U": r.normal(0, n**-0.5, (n, n)), "w": r.normal(0, n**-0.5, n), "c": r.normal(0, n**-0.5, n), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def fit(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.mean) / self.scale
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bag = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]]))
        p = self.p
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            f = self.forward(x, first, bag)
            h, t, g, a = f["h"], f["t"], f["g"], f["a"]
            do = ((f["y"] - label) / len(label)).astype(np.float32)
            dz = (do[:, None] * p["c"])[bag]
            da = (dz * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, first)[bag])
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ do, "d": do.sum(keepdims=True)}
            for k, q in p.items():
                d = grad[k] + decay * q
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        return self.forward((x - self.mean) / self.scale, np.flatnonzero(new), np.cumsum(new) - 1)["y"]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 0):
        x, owner = encode(batch.column(0))
        edge = np.searchsorted(owner, np.arange(len(batch) + 1))
        raw = [x[a:b].tobytes() for a, b in zip(edge, edge[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1)], names=["bag", "label"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """The model learned from at most ``sample`` labelled rows outside the held-out fold; None where none is labelled."""
    id_ = F.col("doc_id").cast("long")
    usable = labels.select(id_.alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    bags = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label")).mapInArrow(_bags, "bag binary, label int").toArrow()
    if not len(bags):
        return None
    parts = [np.frombuffer(b, np.float32).reshape(-1, DENSE + HASHED) for b in bags["bag"].to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    # the order of collected rows must not matter
    label = np.array(bags["label"].to_pylist(), np.float32)
    order = sorted(range(len(parts)), key=lambda i: (label[i], parts[i].tobytes()))
    x = np.concatenate([parts[i] for i in order])
    owner = np.repeat(np.arange(len(order)), [len(parts[i]) for i in order])
    model = Attention(x.shape[1])
    model.fit(x, owner, label[order])
    return model


def _scorer(model: Attention | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            score = model.score(*encode(batch.column(1))) if model else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score.astype(np.float64)), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels, sample)
    rows = ids_and_texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")
