"""Look-up of 64-bit codes on whole arrays: open addressing, one gather a probe.

Held by a Python worker between batches, so that what is known about a piece of text is computed once.
"""

from __future__ import annotations

import numpy as np


class CodeIndex:
    """Slot numbers of codes; ``add`` numbers new codes in the order they come."""

    def __init__(self, bits: int = 14):
        self._clear(bits)
        self.size = 0

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.slots = np.zeros(1 << bits, np.int32)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Slot of each code, -1 for those not known."""
        codes = np.maximum(codes, np.uint64(1))
        out = np.full(len(codes), -1, np.int32)
        at, todo = self._home(codes), np.arange(len(codes))
        while len(todo):
            key = self.keys[at]
            hit = key == codes[todo]
            out[todo[hit]] = self.slots[at[hit]]
            go = ~hit & (key != 0)
            todo, at = todo[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def add(self, codes: np.ndarray) -> np.ndarray:
        """Slots of new codes, which are distinct and not known yet."""
        codes = np.maximum(codes, np.uint64(1))
        slots = np.arange(self.size, self.size + len(codes), dtype=np.int32)
        self.size += len(codes)
        if 2 * self.size > len(self.keys):
            old = self.keys != 0
            keys, held = self.keys[old], self.slots[old]
            self._clear(int(2 * self.size).bit_length())
            self._put(keys, held)
        self._put(codes, slots)
        return slots

    def _put(self, codes: np.ndarray, slots: np.ndarray) -> None:
        at = self._home(codes)
        while len(codes):
            free = self.keys[at] == 0
            self.keys[at[free]] = codes[free]  # of two codes on one place the last stays
            mine = free & (self.keys[at] == codes)
            self.slots[at[mine]] = slots[mine]
            codes, slots = codes[~mine], slots[~mine]
            at = (at[~mine] + 1) & (len(self.keys) - 1)


class Grown:
    """An array that is appended to in place, doubling its room."""

    def __init__(self, dtype, head: tuple = ()):
        self.room = np.zeros(1 << 10, dtype)
        self.n = len(head)
        self.room[: self.n] = head

    def append(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(need, 2 * len(self.room)) - self.n, self.room.dtype)])
        self.room[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


def gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of all members of ragged groups, one group after the other."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)
