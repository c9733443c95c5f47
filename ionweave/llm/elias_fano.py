"""Elias-Fano sequences and a two-level n-gram trie on them, as arrays in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

CONTEXT_BITS = 40


def mapped(data: np.ndarray) -> np.ndarray:
    """The same bytes in an anonymous memory map."""
    raw = np.ascontiguousarray(data)
    if not raw.nbytes:
        return raw
    space = mmap.mmap(-1, raw.nbytes)
    space.write(raw.tobytes())
    return np.frombuffer(space, raw.dtype).reshape(raw.shape)


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed side by side, high bits as gaps in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, np.uint64)
        self.size = len(values)
        self.low_bits = max(0, min(56, (universe // max(1, self.size)).bit_length() - 1))
        low = values & np.uint64((1 << self.low_bits) - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        buckets = (universe >> self.low_bits) + 1
        unary = np.zeros(self.size + buckets, bool)
        unary[high + np.arange(self.size)] = True
        self.high = mapped(np.packbits(unary, bitorder="little"))
        self.high_len = len(unary)
        packed = np.zeros(self.size * self.low_bits // 8 + 9, np.uint8)
        for at in range(0, self.size, 1 << 16):  # bits of a slice of the numbers at a time; slices start at whole bytes
            part = low[at:at + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :self.low_bits]
            data = np.packbits(bits.reshape(-1), bitorder="little")
            packed[at * self.low_bits // 8:at * self.low_bits // 8 + len(data)] = data
        self.low = mapped(packed)

    def directory(self) -> np.ndarray:
        """Number of values below every bucket of high bits, from the zeros of the unary part."""
        zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[:self.high_len] == 0)
        return np.concatenate([[0], zeros - np.arange(len(zeros))])

    def lows(self, index: np.ndarray) -> np.ndarray:
        window = np.ndarray((len(self.low) - 7,), np.dtype("<u8"), self.low, strides=(1,))
        bit = index * self.low_bits
        return (window[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[:self.high_len])
        high = (ones - np.arange(self.size)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.lows(np.arange(self.size))

    def find(self, wanted: np.ndarray, directory: np.ndarray) -> np.ndarray:
        """Index of each wanted value, or -1: successor search among the low bits of its bucket."""
        wanted = np.asarray(wanted, np.uint64)
        bucket = np.minimum(wanted >> np.uint64(self.low_bits), np.uint64(len(directory) - 1)).astype(np.int64)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        left, right = directory[bucket], directory[np.minimum(bucket + 1, len(directory) - 1)]
        end = right.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            below = self.lows(middle) < low[open_]
            left[open_[below]] = middle[below] + 1
            right[open_[~below]] = middle[~below]
            open_ = open_[left[open_] < right[open_]]
        hit = np.flatnonzero(left < end)
        hit = hit[self.lows(left[hit]) == low[hit]]
        out = np.full(len(wanted), -1, np.int64)
        out[hit] = left[hit]
        return out

    def nbytes(self) -> int:
        return self.high.nbytes + self.low.nbytes


class Quantised:
    """Numbers as one-byte codes of 256 bins of equal width; a bin stands for the mean of its numbers."""

    def __init__(self, values: np.ndarray):
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        code = np.minimum((values - low) * (256 / ((high - low) or 1.0)), 255).astype(np.int64)
        total, count = np.bincount(code, values, 256), np.bincount(code, minlength=256)
        self.codes, self.means = mapped(code.astype(np.uint8)), total / np.maximum(count, 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        return self.means[self.codes[index]]


class Trie:
    """Words, and under each word the contexts it was seen in, with quantised values on both levels.

    Level 1 holds word hashes, level 2 the context hashes of every word relative to the word's own range, which
    makes the whole level one rising sequence; rising pointers give the ranges.
    """

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, word_values: np.ndarray, pair_values: np.ndarray):
        self.words = EliasFano(words, 1 << 64)
        keys = (pair_word.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | pair_context.astype(np.uint64)
        self.contexts = EliasFano(keys, max(1, len(words)) << CONTEXT_BITS)
        self.pointers = EliasFano(np.searchsorted(pair_word, np.arange(len(words) + 1)), len(pair_word) + 1)
        self.word_values, self.pair_values = Quantised(word_values), Quantised(pair_values)
        self._words, self._contexts = self.words.directory(), self.contexts.directory()

    def find_words(self, words: np.ndarray) -> np.ndarray:
        return self.words.find(words, self._words)

    def find_contexts(self, nodes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Position of each context under its word's node, or -1; a node of -1 has none."""
        out = np.full(len(nodes), -1, np.int64)
        known = np.flatnonzero(nodes >= 0)
        keys = (nodes[known].astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts[known].astype(np.uint64)
        out[known] = self.contexts.find(keys, self._contexts)
        return out

    def ranges(self) -> np.ndarray:
        return self.pointers.values().astype(np.int64)

    def nbytes(self) -> int:
        return self.words.nbytes() + self.contexts.nbytes() + self.pointers.nbytes() + len(self.word_values.codes) + len(self.pair_values.codes)
