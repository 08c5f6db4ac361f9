"""Ids of pieces of text that a worker keeps for later batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + size[0]], flat[start[1] : ...], ... in one array."""
    total = int(size.sum())
    narrow = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (np.cumsum(size) - size)).astype(narrow), size)
    at += np.arange(total, dtype=narrow)
    return flat[at]


class Kept:
    """Pieces in an Arrow array and their ids in one flat array, up to most pieces in each of two generations."""

    def __init__(self, most: int) -> None:
        self.most, self.words, self.flat = most, pa.array([], pa.string()), np.empty(0, np.uint32)
        self.start, self.size, self._seen = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def places(self, words: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Places of distinct words; those that aren't here are learned first: learn gives their ids in a row and the number of each word's."""
        if len(self.words) + len(words) > 2 * self.most:
            self._age()
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            learned = words.take(pa.array(new))
            ids, sizes = learn(learned)
            at[new] = np.arange(len(new)) + len(self.size)
            self.words = pa.concat_arrays([self.words, learned])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, ids])
            self._seen = np.concatenate([self._seen, np.zeros(len(new), bool)])
        self._seen[at] = True
        pa.default_memory_pool().release_unused()
        return at

    def _age(self) -> None:
        """Forget what was not met since this was last done; all, if that would leave too many."""
        keep = np.flatnonzero(self._seen)
        if len(keep) > self.most:
            keep = keep[:0]
        sizes = self.size[keep]
        self.words, self.flat = self.words.take(pa.array(keep)), gather(self.flat, self.start[keep], sizes)
        self.start, self.size, self._seen = np.cumsum(sizes) - sizes, sizes, np.zeros(len(keep), bool)
