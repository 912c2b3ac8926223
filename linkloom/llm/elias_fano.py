"""Elias-Fano sequences and a two-level n-gram trie of them, over flat arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Quantised values of a trie.
LEVELS = 65_535


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of ``width`` bits, one after the other, in 64-bit words."""
    if not width or not len(values):
        return np.zeros(1, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    out = np.zeros(int(len(values) * width // 64) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
    over = np.where(shift > 0, values >> ((_U(64) - shift) & _U(63)), _U(0))
    over[shift.astype(np.int64) + width <= 64] = 0
    out[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    return out


def _field(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << width) - 1)


class EliasFano:
    """A rising sequence of 64-bit numbers: low bits as they are, high bits in unary.

    ``find`` gives the position of the successor of each query: a select on the zeros of the
    unary part leads to the few entries with the same high bits, which are compared in turn.
    """

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.width, self.low, self.high, self.ones = size, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        width = min(width, 63)
        values = values.astype(np.uint64)
        top = (values >> _U(width)).astype(np.int64) + np.arange(n)
        length = (max(universe - 1, 0) >> width) + n + 2
        bits = np.zeros(length + 63 & ~63, np.uint8)
        bits[top] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, width, _pack(values & _U((1 << width) - 1), width), high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.width], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])

    @staticmethod
    def _within(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the ``rank``-th one (from 0) of each word."""
        place = np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = word & _U((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            go = rank >= count
            rank = rank - np.where(go, count, 0)
            word = np.where(go, word >> _U(width), low)
            place += np.where(go, width, 0)
        return place

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        before = self.ones.astype(np.int64)
        if zeros:
            before = np.arange(len(before), dtype=np.int64) * 64 - before
        word = np.searchsorted(before, rank, side="right") - 1
        bits = self.high[word]
        return word * 64 + self._within(~bits if zeros else bits, rank - before[word])

    def get(self, index: np.ndarray) -> np.ndarray:
        """The entries at ``index``."""
        top = self._select(index.astype(np.int64), False) - index
        return (top.astype(np.uint64) << _U(self.width)) | _field(self.low, index, self.width)

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first entry not below each value, whether it equals the value), among entries from ``low`` to ``high`` if given."""
        values = values.astype(np.uint64)
        top, rest = (values >> _U(self.width)).astype(np.int64), values & _U((1 << self.width) - 1)
        # entries of the bucket `top` lie between its zero and the zero before
        at = np.where(top > 0, self._select(np.maximum(top - 1, 0), True) - np.maximum(top - 1, 0), 0)
        end = self._select(top, True) - top
        if low is not None:
            at, end = np.maximum(at, low), np.minimum(end, high)
        equal = np.zeros(len(values), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = _field(self.low, at[todo], self.width)
            equal[todo] = here == rest[todo]
            todo = todo[here < rest[todo]]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return at, equal


class NgramTrie:
    """Words, and under each word the contexts it was seen after, with a quantised value for each.

    Suffix order: the first level is the predicted word, the second its context.  ``pointers``, one monotone sequence,
    gives each word's range of the second level.  A range holds its contexts' numbers, raised by the last
    entry of the range before it and one, so that the whole level rises.  A search therefore starts with the word's
    two pointers: the entry before the range is what its numbers are relative to, and the
    successor is looked for inside the range only.  ``counts`` are the words' own counts.
    """

    def __init__(self, words: EliasFano, contexts: EliasFano, pairs: EliasFano, pointers: EliasFano, codes: np.ndarray, counts: np.ndarray, scale: np.ndarray):
        self.words, self.contexts, self.pairs, self.pointers, self.codes, self.counts, self.scale = words, contexts, pairs, pointers, codes, counts, scale

    @classmethod
    def build(cls, word: np.ndarray, context: np.ndarray, value: np.ndarray, counts: np.ndarray | None = None) -> NgramTrie:
        """From distinct (word, context) hashes, sorted by both, with a value each, and a count for each distinct word."""
        start = np.flatnonzero(np.diff(word, prepend=word[:1] ^ _U(1)) != 0) if len(word) else np.zeros(0, np.int64)
        words = word[start]
        edges = np.append(start, len(word))
        contexts, place = np.unique(context, return_inverse=True)
        last = place[edges[1:] - 1] + 1 if len(start) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        raised = (np.repeat(base, np.diff(edges)) + place).astype(np.uint64)
        low, high = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        step = (high - low) / (LEVELS - 1) or 1.0
        codes = np.round((value - low) / step).astype(np.uint16)
        return cls(
            EliasFano.build(words, 1 << 64), EliasFano.build(contexts, 1 << 64), EliasFano.build(raised, int(last.sum()) + 1),
            EliasFano.build(edges.astype(np.uint64), len(word) + 1), codes, np.zeros(len(words), np.uint64) if counts is None else counts.astype(np.uint64), np.array([low, step]),
        )

    def _ranges(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry, entry after the last, what numbers are relative to) of words by number."""
        low, high = self.pointers.get(number).astype(np.int64), self.pointers.get(number + 1).astype(np.int64)
        base = np.zeros(len(number), np.int64)
        inner = np.flatnonzero(low > 0)
        base[inner] = self.pairs.get(low[inner] - 1).astype(np.int64) + 1
        return low, high, base

    def codes_of(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The quantised value of each (word, context) plus one; 0 where the trie lacks it."""
        out = np.zeros(len(word), np.int64)
        if not self.words.size:
            return out
        number, known = self.words.find(word)
        place, seen = self.contexts.find(context)
        ask = np.flatnonzero(known & seen)
        distinct, of = np.unique(number[ask], return_inverse=True)
        low, high, base = self._ranges(distinct)
        wanted = place[ask] + base[of]
        inside = wanted <= self.pairs.get(high - 1).astype(np.int64)[of] if len(ask) else np.zeros(0, bool)
        ask, of, wanted = ask[inside], of[inside], wanted[inside]
        at, equal = self.pairs.find(wanted, low[of], high[of])
        out[ask[equal]] = self.codes[at[equal]].astype(np.int64) + 1
        return out

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes from ``codes_of`` that aren't 0."""
        return self.scale[0] + (codes - 1) * self.scale[1]

    def lookup(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each (word, context)."""
        codes = self.codes_of(word, context)
        return np.where(codes > 0, self.values(codes), 0.0), codes > 0

    def counts_of(self, word: np.ndarray) -> np.ndarray:
        """The count of each word, 0 of unknown ones."""
        if not self.words.size:
            return np.zeros(len(word), np.int64)
        number, known = self.words.find(word)
        return np.where(known, self.counts[np.minimum(number, self.words.size - 1)], 0).astype(np.int64)

    def successors(self, word: int) -> np.ndarray:
        """Hashes of the contexts of a word."""
        number, known = self.words.find(np.array([word], np.uint64))
        if not known[0]:
            return np.zeros(0, np.uint64)
        low, high, base = self._ranges(number[:1])
        return self.contexts.get(self.pairs.get(np.arange(low[0], high[0])).astype(np.int64) - base[0])

    def to_bytes(self) -> bytes:
        """A table of array types and lengths, then the arrays, each at a multiple of 64 bytes."""
        arrays = [a for level in (self.words, self.contexts, self.pairs, self.pointers) for a in level.arrays()] + [self.codes, self.counts, self.scale]
        out = bytearray(np.array([[np.dtype(a.dtype).num, len(a)] for a in arrays], np.int64).tobytes())
        for a in arrays:
            out += b"\0" * (-len(out) % 64)
            out += a.tobytes()
        return bytes(out)

    @classmethod
    def of_buffer(cls, buffer) -> NgramTrie:
        """The levels as views of a buffer: nothing is unpacked."""
        raw = np.frombuffer(buffer, np.uint8)
        head = raw[: 19 * 16].view(np.int64).reshape(19, 2)
        kinds = {np.dtype(t).num: np.dtype(t) for t in ("i8", "u8", "u4", "u2", "f8")}
        at, arrays = 19 * 16, []
        for number, length in head.tolist():
            at += -at % 64
            kind = kinds[number]
            arrays.append(raw[at : at + length * kind.itemsize].view(kind))
            at += length * kind.itemsize
        return cls(*(EliasFano.of(arrays[4 * n : 4 * n + 4]) for n in range(4)), *arrays[16:])

    @classmethod
    def mapped(cls, raw: bytes) -> NgramTrie:
        """The levels in a memory map of their own that no file stands behind, so an executor needs no local folder."""
        import mmap

        memory = mmap.mmap(-1, len(raw))
        memory.write(raw)
        return cls.of_buffer(memory)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """The file's levels, memory-mapped."""
        return cls.of_buffer(np.memmap(path, np.uint8, "r"))
