"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut where the tokenizer's pattern always cuts (before a single space, at line ends), so that a unit is a word with what
clings to it. Units new to a worker are cut by the full pattern, and their pieces go through the contiguous rank
arrays of bpe.py together; known units are looked up. Decoding turns ids into bytes by the vocabulary and
reads those as UTF-8.

Null texts count as empty: no ids, and the empty text back. Every row comes back, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe
from .common import bounded, ids_and_texts, ship, shipped
from .lexicon import WHITE
from .memo import Memo

UNITS, PIECES = 300_000, 150_000
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_TOUCHING = re.compile(f"[{WHITE}][{WHITE}]")
_BEFORE_SPACE = re.compile(f"(?= [^{WHITE}])")


class Codec:
    def __init__(self, path: str):
        self.merges = bpe.load(path)
        self.special = self.merges.special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.decimal = [str(i) for i in range(max(self.merges.bytes_of) + 1)]
        #: unit -> (ids as decimals joined by commas, their bytes); ``spaced`` has units without the space before them
        self.plain, self.spaced, self.pieces = Memo(UNITS // 4), Memo(UNITS), Memo(PIECES)

    def _merged(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        token, decimal = self.merges.bytes_of.__getitem__, self.decimal.__getitem__
        return [(",".join(map(decimal, ids)), b"".join(map(token, ids))) for ids in self.merges.encode([p.encode() for p in pieces])]

    def _units(self, space: str):
        def make(units: list[str]) -> list[tuple[str, bytes]]:
            cut = [[space + u] if u.isalpha() else _PIECE.findall(space + u) for u in units]
            known = self.pieces.fill({p for c in cut for p in c}, self._merged)
            out = []
            for parts in cut:
                if len(parts) == 1:
                    out.append(known(parts[0]))
                else:
                    ids, raw = zip(*map(known, parts)) if parts else ((), ())
                    out.append((",".join(ids), b"".join(raw)))
            return out

        return make

    def cut(self, text: str) -> tuple[list[str], list[list[str]]]:
        """Units: either all as they are, or lines of words, of which all but a line's first have a space before them."""
        if _TOUCHING.search(text):
            return _BEFORE_SPACE.split(text), []
        return [], [line.split(" ") for line in text.split("\n")]

    def _sections(self, text: str) -> list[str]:
        return self.cut_special.split(text) if "<|" in text else [text]

    def encode_batch(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text, its ids joined by commas and the bytes that they stand for."""
        todo = [[(s, *((None, None) if s in self.special else self.cut(s))) for s in self._sections(t) if s] for t in texts]
        plain = {u for t in todo for _, units, lines in t if units is not None for u in (units or [x[0] for x in lines])}
        spaced: set = set()
        for t in todo:
            for _, _, lines in t:
                for line in lines or ():
                    spaced.update(line[1:])
        plain = self.plain.fill(plain | {"\n"}, self._units(""))
        spaced = self.spaced.fill(spaced, self._units(" "))
        newline = plain("\n")
        out = []
        for t in todo:
            found: list[tuple[str, bytes]] = []
            for section, units, lines in t:
                if units is None:
                    i = self.special[section]
                    found.append((str(i), self.merges.bytes_of[i]))
                elif units:
                    found.extend(map(plain, units))
                else:
                    for k, line in enumerate(lines):
                        if k:
                            found.append(newline)
                        found.append(plain(line[0]))
                        found.extend(map(spaced, line[1:]))
            if found:
                ids, raw = zip(*found)
                out.append((",".join(filter(None, ids)), b"".join(raw)))
            else:
                out.append(("", b""))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.merges.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def _valid(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(shipped(name))
        for part in bounded(batches, 1):
            coded = codec.encode_batch([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in coded], pa.string()),
                    pa.array([hashlib.sha256(_valid(raw)).hexdigest() for _, raw in coded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``; ``vocabulary``: a byte-level BPE tokenizer file."""
    return ids_and_texts(docs).mapInArrow(_digests(ship(docs.sparkSession, vocabulary)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
