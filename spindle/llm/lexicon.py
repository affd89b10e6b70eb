"""The word-level reading of a ``word_bpe`` tokenizer file: normalise, cut into pieces, merge bytes.

Such a tokenizer drops white space, so a text's ids are those of its white-space separated words, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from . import bpe
from .memo import Memo
from .transducer import WHITE, Forms

PIECES = 300_000
#: str.split() also cuts at these four; Unicode's White_Space doesn't have them.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_GAP = re.compile(f"[{WHITE}]+")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


def split_words(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [w for w in _GAP.split(text) if w]
    return text.split()


def is_white(char: str) -> bool:
    return char.isspace() and not "\x1c" <= char <= "\x1f"


class Lexicon:
    def __init__(self, path: str):
        self.merges = bpe.load(path)
        self.special = self.merges.special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.packs, self.forms = Memo(PIECES), Forms(Tokenizer.from_file(path))

    def pieces(self, word: str) -> str | list[str | int]:
        """The strings that are merged on their own (one alone as it is); a special token's string is its id."""
        if "<|" in word and self.cut_special.search(word):
            out: list = []
            for part in self.cut_special.split(word):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    own = self.pieces(part)
                    out += [own] if type(own) is str else own
            return out
        if not word.isascii():
            if not self.forms.agreed(word):
                word = self.forms.normalised(word)
                return [word[a:b] for _, (a, b) in self.forms.library.pre_tokenizer.pre_tokenize_str(word)]
            word = self.forms.normalised(word)
        else:
            word = word.lower()
        return word if word.isalpha() else _PIECE.findall(word)

    def pack(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        return self._each(words, self.packs, self.merges.pack, b"".join)

    def _each(self, words: list[str], memo: Memo, merge: Callable, join: Callable) -> list:
        cut, wanted = [], set()
        for word in words:
            # most words are letters, or letters and one mark; all others are cut by the rules
            if word.isascii():
                own = word.lower()
                if not own.isalpha():
                    own = (own[:-1], own[-1]) if own[-1] in ",." and own[:-1].isalpha() else self.pieces(word)
            else:
                own = self.pieces(word)
            cut.append(own)
            if type(own) is str:
                wanted.add(own)
            else:
                wanted.update(own)
        value = memo.fill(wanted, lambda new: self._merged(new, merge))
        return [value(c) if type(c) is str else value(c[0]) + value(c[1]) if len(c) == 2 else join([value(p) for p in c]) for c in cut]

    def _merged(self, pieces: list[str | int], merge: Callable) -> list:
        values = merge([p.encode() if type(p) is str else b"" for p in pieces])
        for k, p in enumerate(pieces):
            if type(p) is int:
                values[k] = p.to_bytes(4, "little")
        return values


@lru_cache(maxsize=4)
def load(path: str) -> Lexicon:
    return Lexicon(path)
