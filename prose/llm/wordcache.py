"""Token lists of words, looked up for a whole batch at once.

A tokenizer that never joins across white space gives a word the same tokens wherever it stands.
So each different word of a batch is encoded once and kept in the worker; the tokens of the whole
batch are then gathered by numpy. The cache holds at most ``MAX_WORDS`` words and starts anew when
it is full, which changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

MAX_WORDS = 1_500_000
#: Words handed to the tokenizer at once; it returns objects of more than a kilobyte a word.
CHUNK = 4096


class WordCache:
    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.encode = encode
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.rank = np.empty(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        return np.where(found, self.rank[at] if len(self.keys) else -1, -1)

    def lookup(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every word; ``word(i)`` gives the i-th word's text if its hash is new."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self._slots(keys)
        new = np.flatnonzero(slots < 0)
        if len(self.keys) and len(self.keys) + len(new) > MAX_WORDS:
            self._reset()
            slots = np.full(len(keys), -1)
            new = np.arange(len(keys))
        if len(new):
            slots[new] = len(self.starts) - 1 + np.arange(len(new))
            starts, ids = [self.starts], [self.ids]
            for k in range(0, len(new), CHUNK):
                lists = self.encode([word(i) for i in first[new[k : k + CHUNK]].tolist()])
                starts.append(starts[-1][-1] + np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))))
                ids.append(np.fromiter(chain.from_iterable(lists), dtype=np.int32))
            self.starts, self.ids = np.concatenate(starts), np.concatenate(ids)
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.rank = np.insert(self.keys, at, keys[new]), np.insert(self.rank, at, slots[new])
        return slots[inverse], inverse

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self.starts[slots + 1] - self.starts[slots]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of all entries, one after the other."""
        lengths = self.lengths(slots)
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[slots] - (ends - lengths), lengths)
        return self.ids[at]
