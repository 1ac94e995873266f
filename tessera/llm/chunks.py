"""Encoding texts chunk by chunk, each distinct chunk once.

Both tokenizers used here never join bytes over certain boundaries, so a text's ids are its chunks' ids in a row. A
worker keeps the ids of the chunks that it has met, by 64-bit hash, in sorted arrays of a bounded number of entries. Chunks with
equal hashes are taken for equal: among a million and a half entries two differ and agree with a probability under 1e-7.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.llm import text

#: Entries and ids that a worker keeps at most; then it starts anew. Bounds memory, not results.
CACHE_CHUNKS, CACHE_IDS = 1_500_000, 12_000_000
#: Bytes of text that are encoded at once: every pass merges its new chunks into the sorted arrays, so passes are few and large.
PASS_BYTES = 1 << 20


class ChunkEncoder:
    """``encode`` turns a list of chunks into a list of id lists."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        found = self.encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        slots = len(self.at) - 1 + np.arange(len(h))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.int32)])
        place = np.searchsorted(self.hashes, h)
        self.hashes, self.slots = np.insert(self.hashes, place, h), np.insert(self.slots, place, slots)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in a row, and the number of ids before each chunk (n + 1 numbers)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        h, first, which = np.unique(text.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(h) > CACHE_CHUNKS or len(self.ids) > CACHE_IDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        fresh = np.flatnonzero(self.hashes[place] != h) if len(self.hashes) else np.arange(len(h))
        if len(fresh):
            self._learn(data, h[fresh], starts[first[fresh]], ends[first[fresh]])
            place = np.searchsorted(self.hashes, h)
        slot = self.slots[place][which]
        n = self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.at[slot] - total[:-1], n) + np.arange(total[-1])], total
