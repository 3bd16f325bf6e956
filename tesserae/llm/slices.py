"""Vectorised lookup: numbers of 64-bit keys, and of byte slices seen before."""

from __future__ import annotations

import numpy as np

from tesserae.llm.blocks import mix, ranges, slice_hashes


class Index:
    """Open addressing in arrays: distinct 64-bit keys and a number for each; all keys of a call are looked up at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at = self._slots(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((self.keys[at] != keys) & (self.values[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            here, value = self.keys[at[left]], self.values[at[left]]
            same = here == keys[left]
            out[left[same]] = value[same]
            left = left[~same & (value >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.values >= 0)
            grown = Index(max(self.bits + 1, int(2 * (self.used + len(keys))).bit_length()))
            grown.put(self.keys[old], self.values[old])
            self.bits, self.keys, self.values = grown.bits, grown.keys, grown.values
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.values[at[left]] < 0
            slot, first = np.unique(at[left], return_index=True)
            mine = left[first[free[first]]]
            self.keys[at[mine]], self.values[at[mine]] = keys[mine], values[mine]
            left = left[(self.keys[at[left]] != keys[left]) | (self.values[at[left]] != values[left])]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.used += len(keys)


class Slices:
    """Numbers of byte slices, found by a hash and confirmed on the bytes."""

    def __init__(self):
        self.index, self.count = Index(), 0
        self.data, self.start, self.size, self.used = np.zeros(1 << 16, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each slice or -1, its hash)."""
        h = slice_hashes(data, starts, ends)
        code = self.index.get(h)
        lengths = ends - starts
        hit = np.flatnonzero(code >= 0)
        hit = hit[self.size[code[hit]] == lengths[hit]] if len(hit) else hit
        mine, theirs = data[ranges(starts[hit], lengths[hit])], self.data[ranges(self.start[code[hit]], lengths[hit])]
        wrong = np.repeat(np.arange(len(hit)), lengths[hit])[mine != theirs]
        sure = np.full(len(code), -1, np.int64)
        sure[hit] = code[hit]
        sure[hit[wrong]] = -1
        return sure, h

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers for distinct slices that were not found."""
        lengths = ends - starts
        code = self.count + np.arange(len(starts))
        total = int(lengths.sum())
        while self.used + total > len(self.data):
            self.data = np.append(self.data, np.zeros(len(self.data), np.uint8))
        self.data[self.used : self.used + total] = data[ranges(starts, lengths)]
        self.start = np.append(self.start, self.used + np.cumsum(lengths) - lengths)
        self.size = np.append(self.size, lengths)
        self.used, self.count = self.used + total, self.count + len(starts)
        # Of slices with one hash, one is found again and the others are added anew each time.
        _, first = np.unique(h, return_index=True)
        first = first[self.index.get(h[first]) < 0]
        self.index.put(h[first], code[first])
        return code
