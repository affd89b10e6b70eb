"""Token counts of whole texts by a compiled finite-state transducer (transducer.py).

Each text is normalised, and each chunk of ``CHUNK`` characters of it becomes a map from the state before it to the state after it
and the tokens emitted. All states meet in the start state at the first white space, so a map is (text before it, to be read from
whatever state comes in; tokens after it; state at the end). Maps compose associatively and are combined in a
balanced prefix scan. What a word emits from gap to gap is kept as one arc from the start state to itself, ``ARCS`` at most.

Null and empty texts count 0 tokens and 0 bytes. Every row comes back, repeated ones too. A batch's texts have about 4 MB at most,
or are one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import lexicon
from .common import bounded, ids_and_texts, ship, shipped
from .memo import Memo
from .transducer import Reader, Transducer, compiled

LIMIT, CHUNK, ARCS = 2048, 1 << 16, 300_000


@dataclass(frozen=True, slots=True)
class StateMap:
    """What a chunk does. ``state`` None: it holds no white space, and ``head`` is all of it."""

    head: str
    tokens: int = 0
    state: Reader | None = None


class Counter:
    def __init__(self, machine: Transducer):
        self.machine, self.arcs = machine, Memo(ARCS)

    def _emitted(self, words: list[str]) -> list[int]:
        """The tokens of whole words, gap to gap."""
        if self.machine.full():
            self.machine.renew()
        run, start = self.machine.run, self.machine.start
        return [run(start, w)[1] for w in words]

    def read(self, chunk: str) -> StateMap:
        words = lexicon.split_words(chunk)
        if not chunk or (len(words) == 1 and len(words[0]) == len(chunk)):
            return StateMap(chunk)
        head = "" if not words or lexicon.is_white(chunk[0]) else words[0]
        tail = "" if not words or lexicon.is_white(chunk[-1]) else words[-1]
        own = words[bool(head) : len(words) - bool(tail)]
        state, tokens = self.machine.run(self.machine.start, tail)
        try:
            tokens += sum(map(self.arcs.young.__getitem__, own))
        except KeyError:
            tokens += sum(map(self.arcs.fill(set(own), self._emitted), own))
        return StateMap(head, tokens, state)

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        if x.state is None:
            return StateMap(x.head + y.head, y.tokens, y.state)
        state, tokens = self.machine.run(x.state, y.head)
        return StateMap(x.head, x.tokens + tokens + y.tokens, state if y.state is None else y.state)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """The maps' product, by halves, as a parallel scan combines them."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else StateMap("")

    def count(self, text: str, chunk: int = CHUNK) -> int:
        total = 0
        for part in self.machine.normalised(text):
            if type(part) is int:
                total += 1
                continue
            whole = self.scan([self.read(part[i : i + chunk]) for i in range(0, len(part), chunk)])
            total += self.machine.run(self.machine.start, whole.head)[1] + whole.tokens
        return total


_counters: dict[str, Counter] = {}


def _count(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = shipped(name)
        counter = _counters.get(path) or _counters.setdefault(path, Counter(compiled(path)))
        for batch in bounded(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``; ``vocabulary``: a word_bpe tokenizer file."""
    return ids_and_texts(docs).mapInArrow(_count(ship(docs.sparkSession, vocabulary), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
