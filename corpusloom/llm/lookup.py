"""Many substrings of many words looked up in a fixed set of strings at once, in numpy.

A string's hash is a polynomial over its codes, so that the hashes of all substrings follow from those of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SLOTS = 18


class Slots:
    """Places of 64-bit keys. Each level is a table of slots; a key whose slot is taken goes to the next level."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two strings have one hash")
        self.levels, left = [], np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left], len(self.levels))
            _, first = np.unique(slot, return_index=True)
            own, ids = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
            own[slot[first]], ids[slot[first]] = keys[left[first]], left[first]
            self.levels.append((own, ids))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * level)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        flat = keys.ravel()
        out = np.full(len(flat), -1, dtype=np.int32)
        todo = None  # the keys that met another one at each level so far
        for level, (own, ids) in enumerate(self.levels):
            some = flat if todo is None else flat[todo]
            slot = self._slot(some, level)
            there = ids[slot]
            same = own[slot] == some
            if todo is None:
                out = np.where(same, there, np.int32(-1))
                todo = np.flatnonzero(~same & (there >= 0))
            else:
                out[todo[same]] = there[same]
                todo = todo[~same & (there >= 0)]
            if not len(todo):
                break
        return out.reshape(keys.shape)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def prefixes(codes: np.ndarray) -> np.ndarray:
    """Of rows of codes: the hash of the first 0, 1, ... of them."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (codes[:, j] + np.uint64(1))
    return out


def keys_of(strings: list) -> np.ndarray:
    """Hashes of strings of letters (by code point) or bytes."""
    out = np.zeros(len(strings), dtype=np.uint64)
    for n, places in by_length(strings):
        own = [strings[i] for i in places]
        codes = coded(own, n) if isinstance(own[0], str) else np.frombuffer(b"".join(own), np.uint8).reshape(len(own), n).astype(np.uint64)
        out[places] = prefixes(codes)[:, -1]
    return out


def coded(words: list[str], n: int) -> np.ndarray:
    """Words of n letters as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n).astype(np.uint64)


def by_length(words: list) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of the words of that length)."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(sizes[places[0]]), places
