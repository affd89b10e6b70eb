"""A bounded memory of computed values that keeps what is in use."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


class Memo:
    """Two generations of at most about ``limit`` entries: a full young one becomes the old one, what is asked for again moves back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, keys: set, make: Callable[[list], Iterable[Any]]) -> Callable[[Any], Any]:
        """Have a value for each of ``keys``, made by ``make`` where none is known; returns the look-up."""
        young = self.young  # asked key by key: a difference of key views goes through all of the memory
        new = {k for k in keys if k not in young}
        if len(self.young) + len(new) > self.limit:
            self.old, self.young, new = self.young, {}, keys
        back = {k for k in new if k in self.old}
        self.young.update(zip(back, map(self.old.__getitem__, back)))
        rest = list(new - back)
        if rest:
            self.young.update(zip(rest, make(rest)))
        return self.young.__getitem__
