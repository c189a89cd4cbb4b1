"""Encoding by units: a text cut at its spaces, each different unit encoded once while a bounded cache holds it."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Entries of a cache before it starts anew. Bounds a worker's memory and never changes results.
CACHE_ENTRIES = 200_000

#: White space before a space that white space or the end follows: there a unit's tokens depend on its neighbours.
_ENTANGLED = re.compile(r"\s (?=\s|\Z)")


class BoundedCache(dict):
    """A dict that is emptied between batches once it has CACHE_ENTRIES entries."""

    def make_room(self) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.clear()


class SpaceSplit:
    """Encodes texts unit by unit where a space always starts a pre-token, and whole elsewhere; the ids are the same.

    A unit is a space with what follows it up to the next one. Patterns of the kind `` ?letters| ?digits| ?others|spaces``
    start a pre-token at each space, unless the space stands between white space, or between white space and the end.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]]):
        self.encode_all = encode_all
        self.cache = BoundedCache()

    def __call__(self, texts: list[str]) -> list[bytes]:
        heads, cut = self._cut(texts, self.encode_all, self.cache)
        cache = self.cache
        return [x if units is None else x + b"".join([cache[u] for u in units]) for x, units in zip(heads, cut, strict=True)]

    @staticmethod
    def _cut(texts: list[str], encode_all, cache: BoundedCache):
        """What each whole text or first unit gives, and the text's other units (None for a whole text), all of them cached."""
        cache.make_room()
        cut = [None if _ENTANGLED.search(t) else t.split(" ") for t in texts]
        fresh = list(set().union(*(units[1:] for units in cut if units is not None)).difference(cache))
        out = encode_all([" " + u for u in fresh] + [t if units is None else units[0] for t, units in zip(texts, cut, strict=True)])
        cache.update(zip(fresh, out))
        return out[len(fresh) :], [units and units[1:] for units in cut]

    @classmethod
    def summed(cls, texts: list[str], count_all, cache: BoundedCache) -> list[tuple]:
        """As for encoding, but for tuples of numbers that add up."""
        heads, cut = cls._cut(texts, count_all, cache)
        return [x if not units else tuple(map(sum, zip(x, *[cache[u] for u in units], strict=True))) for x, units in zip(heads, cut, strict=True)]
