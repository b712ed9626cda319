"""Token ids of whole texts from a public tokenizer file, one encoding per distinct piece.

Byte-level BPE never merges over a space that stands between two visible characters, so a text
may be cut before such a space. Pieces repeat a lot in a corpus: a worker encodes each distinct one
once and gathers the ids of the others. Pieces are told apart by 64-bit codes of their bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fleetcast.llm.code_index import CodeIndex, Grown, gather
from fleetcast.llm.words import span_codes, text_bytes

#: distinct pieces that a worker remembers before it forgets those that did not come again
REMEMBERED = 1 << 19
_AT_ONCE = 1 << 12

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LATIN = 0xC3  # lead byte of U+00C0 to U+00FF, none of which is a space


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions of the spaces before which a text may be cut."""
    at = np.flatnonzero(raw[2:-1] == 0x20) + 2 if len(raw) > 3 else np.zeros(0, np.int64)
    before = _VISIBLE[raw[at - 1]] | ((raw[at - 2] == _LATIN) & (raw[at - 1] >= 0x80))
    after = _VISIBLE[raw[at + 1]] | (raw[at + 1] == _LATIN)
    return at[before & after]


class PieceEncoder:
    """Encodes with remembered pieces; one per worker (``encoder``)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel work
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.index = CodeIndex()
        self.at = Grown(np.int64, (0,))  # ids of slot s are at[s]:at[s + 1]
        self.held = Grown(self.type)
        self.again = np.zeros(self.remembered + 1, bool)  # slots that were met again since they were learnt or kept

    def _thin(self) -> None:
        """Keep the pieces that came again, those kept longest first and no more than half of the room."""
        taken = np.flatnonzero(self.index.keys)
        slot = self.index.slots[taken]
        order = np.argsort(slot)
        codes, slot = self.index.keys[taken[order]], slot[order]
        kept = np.flatnonzero(self.again[np.minimum(slot, self.remembered)] & (slot < self.remembered))[: self.remembered // 2]
        codes, many = codes[kept], self.counts(slot[kept])
        ids = self.ids[gather(self.start[slot[kept]], many)]
        self._forget()
        self.held.append(ids)
        self.at.append(np.cumsum(many))
        self.index.add(codes)

    @property
    def start(self) -> np.ndarray:
        return self.at.values

    @property
    def ids(self) -> np.ndarray:
        return self.held.values

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), _AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[k : k + _AT_ONCE], add_special_tokens=False)]

    def _learn(self, codes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Remember new pieces; returns their slots."""
        for k in range(0, len(texts), _AT_ONCE):
            new = [np.array(x, self.type) for x in self.direct(texts[k : k + _AT_ONCE])]
            self.held.append(np.concatenate(new))
            self.at.append(self.start[-1] + np.cumsum([len(x) for x in new]))
        return self.index.add(codes)

    def pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start byte of each piece of the rows, and the slot of its ids."""
        rows = at[:-1][np.diff(at) > 0]
        if not len(rows):
            return rows, np.zeros(0, np.int32)
        first = np.zeros(len(raw), bool)
        first[rows] = True
        first[cut_points(raw)] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(raw))
        code = span_codes(raw, start, end, fold=False)
        if self.index.size > self.remembered:
            self._thin()
        slot = self.index.find(code)
        self.again[np.minimum(slot[slot >= 0], self.remembered)] = True
        miss = np.flatnonzero(slot < 0)
        if len(miss):  # only what is new is sorted
            new, one, which = np.unique(code[miss], return_index=True, return_inverse=True)
            seen = miss[one]
            slot[miss] = self._learn(new, [raw[s:e].tobytes().decode() for s, e in zip(start[seen].tolist(), end[seen].tolist(), strict=True)])[which]
        return start, slot

    def counts(self, slot: np.ndarray) -> np.ndarray:
        return np.diff(self.start)[slot]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and where each row begins (n + 1 values)."""
        raw, at = text_bytes(column)
        start, slot = self.pieces(raw, at)
        many = self.counts(slot)
        total = np.concatenate([[0], np.cumsum(many)])
        return self.ids[gather(self.start[slot], many)], total[np.searchsorted(start, at)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
