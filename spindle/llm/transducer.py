"""A word tokenizer compiled to a deterministic transducer whose transitions carry emitted-token counts.

Byte-pair encoding of a piece is read from left to right without merging. A nondeterministic automaton walks the vocabulary's trie: an
item (node, last token, count) says that a token may have begun after ``last token``, and has got as far as ``node``. Where the node
spells a token that can stand beside the last one (the pair, merged on its own, stays that pair), the item ends there, and a new one
starts. Of the tokens that could end a prefix, exactly one stands beside what its own start ended with, so the subset construction
gives one count a prefix. A subset, with counts relative to each other, is a state (``Piece``); few are ever met, and they are made when
they are.

``Reader`` states put pieces together as the pre-tokenizer cuts them: letters, single digits, runs of anything else, contractions. A
transition on a character emits the change in the number of tokens that the text would have if it ended there, so that a text's
count is the sum over its transitions, whatever its last state. Letter classes and lower case are asked of the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from . import bpe

#: Unicode's White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP, _LETTER, _NUMBER = regex.compile(f"[{WHITE}]+"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}")

#: States held at most; beyond it compilation starts anew (those in use stay valid).
STATES = 300_000
START, LETTERS, OTHER = range(3)
_NEVER = 1 << 40
_NONE = (_NEVER, 0)


class Forms:
    """Normal forms and classes of characters as the library has them, whose Unicode version may differ from Python's.

    A character is compared once; a text that holds only characters on which both agree is normalised here, any other by the library.
    """

    def __init__(self, library: Tokenizer):
        self.library, self.same, self.odd = library, set(map(chr, range(128))), set()
        self.kinds: dict[str, int | None] = {}

    def kind(self, char: str) -> int | None:
        """0: a letter, 1: a digit, 2: neither, None: white space; by the library's pre-tokenizer."""
        if char not in self.kinds:
            found = self.library.pre_tokenizer.pre_tokenize_str(f"a{char}{char}a")
            self.kinds[char] = {1: 0, 4: 1, 3: 2, 2: None}[len(found)]
        return self.kinds[char]

    def agreed(self, text: str) -> bool:
        """Whether Python's own tables can be used for ``text``."""
        if not self.same.issuperset(text):
            for char in set(text) - self.same - self.odd:
                form, here = self.library.normalizer.normalize_str(char), self._own(char)
                fine = (form == here or self.kind(char) is None) and all(self.kind(c) == _own_kind(c) for c in {char, *form})
                (self.same if fine else self.odd).add(char)
            return self.odd.isdisjoint(text)
        return True

    @staticmethod
    def _own(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normalised(self, text: str) -> str:
        """As the library does, but that white space may stay as it is (no reader tells one kind from another)."""
        return self._own(text) if self.agreed(text) else self.library.normalizer.normalize_str(text)


def _own_kind(char: str) -> int | None:
    return None if _GAP.match(char) else 0 if _LETTER.match(char) else 1 if _NUMBER.match(char) else 2


class Piece:
    """A subset of items. ``closed``: tokens if the piece ended here, less those so far."""

    __slots__ = ("items", "closed")

    def __init__(self, items: tuple, closed: int):
        self.items, self.closed = items, closed


class Reader(dict):
    """A state: character -> (state, emitted)."""

    __slots__ = ("machine", "kind", "piece", "tail")

    def __init__(self, machine: Transducer, kind: int, piece: Piece | None, tail: str):
        self.machine, self.kind, self.piece, self.tail = machine, kind, piece, tail

    def __missing__(self, char: str) -> tuple[Reader, int]:
        out = self[char] = self.machine.transition(self, char)
        return out


class Transducer:
    def __init__(self, path: str):
        self.merges = bpe.load(path)
        self.library = Tokenizer.from_file(path)
        self.forms = Forms(self.library)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.contractions = {x for x in pattern.split("|") if x.startswith("'") and x.isascii() and x[1:].isalpha()}
        self.prefixes = {x[:n] for x in self.contractions for n in range(1, len(x))}
        self.special = self.merges.special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        back = {s: b for b, s in enumerate(bpe.byte_symbols())}
        #: the trie: node -> {byte, or 256 + byte for one that ends a word: node}; a node's token
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.spelled: dict[int, list[int]] = {}
        for text, i in spec["model"]["vocab"].items():
            ends = bool(suffix) and text.endswith(suffix)
            raw = [back[c] for c in (text.removesuffix(suffix) if ends else text)]
            if ends:
                raw[-1] += 256
            self.spelled[i] = raw
            node = 0
            for x in raw:
                following = self.trie[node].get(x)
                if following is None:
                    following = self.trie[node][x] = len(self.trie)
                    self.trie.append({}), self.token.append(-1)
                node = following
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]] | None] = {}
        self.renew()

    def renew(self) -> None:
        self.pieces: dict[tuple, Piece] = {}
        self.readers: dict[tuple, Reader] = {}
        self.root = Piece(((0, -1, 0),), 0)
        self.start = Reader(self, START, None, "")

    def full(self) -> bool:
        return len(self.pieces) > STATES

    # pieces

    def spine(self, token: int, right: bool) -> list[tuple[int, int]] | None:
        """The parts at a token's edge while it is merged, each with the rank of the merge that takes it; None if it isn't its own encoding."""
        known = self.spines.get((token, right), 0)
        if known != 0:
            return known
        m = self.merges
        ids = [int(m.final[x - 256] if x > 255 else m.inner[x]) for x in self.spelled[token]]
        edges: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
        while len(ids) > 1:
            rank, merged, i = min(m.by_pair.get(a << 20 | b, (_NEVER, 0)) + (i,) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == _NEVER:
                break
            if i == 0:
                edges[False].append((ids[0], rank))
            if i == len(ids) - 2:
                edges[True].append((ids[-1], rank))
            ids[i : i + 2] = [merged]
        for side, parts in edges.items():
            self.spines[(token, side)] = [*parts, (token, _NEVER)] if ids == [token] else None
        return self.spines[(token, right)]

    def together(self, a: int, b: int) -> bool:
        """Whether tokens a (-1: none) and b can stand side by side: no merge across them comes before those inside."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * STATES:
                self.pairs = {}
            known = self.pairs[key] = self._together(a, b)
        return known

    def _together(self, a: int, b: int) -> bool:
        y = self.spine(b, False)
        if a < 0 or y is None:
            return y is not None
        x, i, j = self.spine(a, True), 0, 0
        while True:
            (left, taken), (right, taken_) = x[i], y[j]
            rank = self.merges.by_pair.get(left << 20 | right, _NONE)[0]
            if rank < taken and rank <= taken_ and rank < _NEVER:
                return False
            if taken == taken_ == _NEVER:
                return True
            if taken <= taken_:
                i += 1
            else:
                j += 1

    def step(self, piece: Piece, byte: int) -> tuple[Piece, int]:
        items, opened, closed, trie, token = [], None, None, self.trie, self.token
        for node, last, count in piece.items:
            edges = trie[node]
            here = edges.get(byte)
            if here is not None:
                if trie[here]:
                    items.append((here, last, count))
                if opened is None and (t := token[here]) >= 0 and self.together(last, t):
                    opened, so_far = t, count + 1
            if closed is None:
                here = edges.get(256 + byte)
                if here is not None and (t := token[here]) >= 0 and self.together(last, t):
                    closed = count + 1
        key = (*[(node, last, count - so_far) for node, last, count in items], (0, opened, 0), closed - so_far)
        to = self.pieces.get(key)
        if to is None:
            to = self.pieces[key] = Piece(key[:-1], key[-1])
        return to, so_far

    def read(self, piece: Piece, char: str) -> tuple[Piece, int]:
        emitted = 0
        for byte in char.encode():
            piece, n = self.step(piece, byte)
            emitted += n
        return piece, emitted

    # texts

    def transition(self, state: Reader, char: str) -> tuple[Reader, int]:
        kind = self.forms.kind(char)
        if kind is None:
            return self.start, 0
        tail = state.tail + char if state.tail else ""
        if tail not in self.contractions and tail not in self.prefixes:
            tail = char if char == "'" and state.kind != OTHER else ""
        if tail in self.contractions:
            parts = [tail[:1], tail[1:-1]] if len(tail) > 2 else [tail[:1]]
            return self.start, self.size(tail) - sum(map(self.size, parts))
        if kind == 1:
            return self.start, self.size(char)
        kind = LETTERS if kind == 0 else OTHER
        goes_on = state.kind == kind
        before = state.piece if goes_on else self.root
        piece, emitted = self.read(before, char)
        key = (kind, id(piece), tail)
        to = self.readers.get(key)
        if to is None:
            to = self.readers[key] = Reader(self, kind, piece, tail)
        return to, emitted + piece.closed - before.closed

    def size(self, piece: str) -> int:
        got, emitted = self.read(self.root, piece)
        return emitted + got.closed

    def run(self, state: Reader, text: str) -> tuple[Reader, int]:
        """The state after ``text`` (normalised) and the tokens emitted on the way."""
        emitted = 0
        for char in text:
            state, n = state[char]
            emitted += n
        return state, emitted

    def normalised(self, text: str) -> list[str | int]:
        """The parts between special tokens, normalised as by the library, and the special tokens' ids."""
        parts = self.cut_special.split(text) if "<|" in text else [text]
        return [self.special[p] if p in self.special else p.lower() if p.isascii() else self.forms.normalised(p) for p in parts if p]


@lru_cache(maxsize=4)
def compiled(path: str) -> Transducer:
    """One transducer a worker process, kept from batch to batch."""
    return Transducer(path)
