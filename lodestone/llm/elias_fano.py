"""Elias-Fano sequences and an n-gram trie of them, in flat buffers that can be memory-mapped.

A monotone sequence of n values below u keeps the low bits of each value packed, and its high parts as a bit vector of n
ones and one zero per high part. Directories count ones and zeros before each 64-bit word. All operations take arrays.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of one number r (from 0) in each 64-bit word."""
    place = np.zeros(len(word), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & _U((1 << step) - 1)).astype(np.uint64)
        go = r >= ones
        r = np.where(go, r - ones, r)
        shift = np.where(go, _U(step), _U(0))
        word = word >> shift
        place += shift
    return place


class EliasFano:
    """A non-decreasing sequence. Its parts: header (n, low width), low words, high words, ones and zeros before each word."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width = int(head[0]), _U(int(head[1]))
        self.parts = (head, low, high, ones, zeros)
        _, self.low, self.high, self.ones, self.zeros = self.parts

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        bits = n * width
        low = np.zeros(bits // 64 + 2, np.uint64)
        if width:
            part = values & _U((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * _U(width)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low[word[cuts]] |= np.bitwise_or.reduceat(part << shift, cuts)
            over = np.flatnonzero(shift + _U(width) > _U(64))
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        place = (values >> _U(width)).astype(np.int64) + np.arange(n)
        size = (last >> width) + n + 1
        bit = np.zeros(size // 64 * 64 + 64, np.uint8)
        bit[place] = 1
        high = np.packbits(bit, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.append(0, np.cumsum(count)).astype(np.uint32 if n < 2**31 else np.uint64)
        zeros = np.append(0, np.cumsum(64 - count)).astype(np.uint32 if size < 2**31 else np.uint64)
        return cls(np.array([n, width], np.uint64), low, high, ones, zeros)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values number i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = _select_in_word(self.high[word], (i - self.ones[word]).astype(np.uint64)) + (word << 6).astype(np.uint64)
        return ((place - i.astype(np.uint64)) << self.width) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.width
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> shift
        over = shift > _U(0)
        value = np.where(over, value | (self.low[word + 1] << np.where(over, _U(64) - shift, _U(0))), value)
        return value & _U((1 << int(self.width)) - 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first value that is at least x, whether it is x); number n where there is none."""
        x = x.astype(np.uint64)
        high = (x >> self.width).astype(np.int64)
        low = x & _U((1 << int(self.width)) - 1)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        total = int(self.zeros[-1])
        place = np.zeros(len(x), np.int64)
        some = (high > 0) & (high <= total)
        k = high[some] - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        place[some] = (word << 6) + _select_in_word(~self.high[word], (k - self.zeros[word]).astype(np.uint64)).astype(np.int64) + 1
        index = np.where(high <= total, place - high, self.n)
        equal = np.zeros(len(x), bool)
        live = np.flatnonzero((index < self.n) & (high <= total))
        # the values with this high part are a run of ones from here; a binary search among their low parts follows
        p = place[live]
        word = np.minimum(p >> 6, len(self.high) - 1)
        shift = (p & 63).astype(np.uint64)
        gap = ~(self.high[word] >> shift)
        run = np.bitwise_count((gap & (~gap + _U(1))) - _U(1)).astype(np.int64)
        run[p >> 6 >= len(self.high)] = 0
        end = index[live] + run
        over = np.flatnonzero((p & 63) + run >= 64)
        if len(over):
            k = high[live[over]]
            known = k < total
            at = np.searchsorted(self.zeros, k[known], "right") - 1
            close = np.full(len(k), self.n, np.int64)
            close[known] = (at << 6) + _select_in_word(~self.high[at], (k[known] - self.zeros[at]).astype(np.uint64)).astype(np.int64) - k[known]
            end[over] = close
        begin, stop = index[live], np.minimum(end, self.n)
        last = stop.copy()
        wanted = low[live]
        open_ = np.flatnonzero(begin < stop)
        while len(open_):
            middle = (begin[open_] + stop[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            begin[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < stop[open_]]
        index[live] = begin
        inside = np.flatnonzero(begin < last)
        equal[live[inside]] = self._low(begin[inside]) == wanted[inside]
        return index, equal


class Trie:
    """n-grams as levels of a trie. Level 0 has the first words. A level below has, for each node above, its successors: word
    ids relative to the node (made monotone by adding the last value of the node before), with monotone pointers to each
    node's first one. The nodes of the last level carry an 8-bit code into a table of log10 probabilities.
    """

    def __init__(self, first: EliasFano, levels: list[tuple[EliasFano, EliasFano]], codes: np.ndarray, table: np.ndarray):
        self.first, self.levels, self.codes, self.table = first, levels, codes, table

    @classmethod
    def build(cls, grams: np.ndarray, log_probability: np.ndarray, bins: int = 255, table: np.ndarray | None = None) -> Trie:
        """grams: rows of word ids, different, in lexicographic order; log_probability: one for each row; table:
        the ascending values that codes stand for, of which each takes the nearest; else ``bins`` equal steps."""
        order = grams.shape[1]
        new = np.ones(len(grams), bool)
        node = np.zeros(len(grams), np.int64)
        levels = []
        first = None
        for k in range(order):
            step = np.zeros(len(grams), bool)
            step[:1] = True
            step[1:] = grams[1:, k] != grams[:-1, k]
            new = step if k == 0 else new | step
            at = np.flatnonzero(new)
            word = grams[at, k].astype(np.uint64)
            if k == 0:
                first = EliasFano.build(word)
            else:
                parent = node[at]
                start = np.searchsorted(parent, np.arange(node[-1] + 2 if len(grams) else 1))
                ends = word[start[1:] - 1] if len(grams) else np.zeros(0, np.uint64)
                base = np.append(np.zeros(1, np.uint64), np.cumsum(ends + _U(1), dtype=np.uint64))[: len(ends)]
                levels.append((EliasFano.build(start), EliasFano.build(word + np.repeat(base, np.diff(start)))))
            node = np.cumsum(new) - 1
        if table is None:
            low, high = (float(log_probability.min()), float(log_probability.max())) if len(grams) else (0.0, 0.0)
            table = np.linspace(low, high, bins)
        table = table.astype(np.float32)
        codes = np.searchsorted((table[1:] + table[:-1]) / 2, log_probability).astype(np.uint8)
        return cls(first, levels, codes, table)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The last level's node of each row; -1 where the trie does not have it. Runs of rows with a common context look it
        up once, so sorted rows are found fastest."""
        if not len(grams):
            return np.zeros(0, np.int64)
        step = np.zeros(len(grams), bool)
        step[0] = True
        step[1:] = grams[1:, 0] != grams[:-1, 0]
        at = np.flatnonzero(step)
        node, ok = self.first.successor(grams[at, 0])
        node = np.where(ok, node, -1)
        for k, (pointers, words) in enumerate(self.levels, 1):
            begin, end, base = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
            known = np.flatnonzero(node >= 0)
            begin[known], end[known] = pointers.access(node[known]), pointers.access(node[known] + 1)
            later = known[begin[known] > 0]
            base[later] = words.access(begin[later] - 1) + _U(1)
            own = np.cumsum(step) - 1  # each row's context
            step = step.copy()
            step[1:] |= grams[1:, k] != grams[:-1, k]
            at = np.flatnonzero(step)
            own = own[at]
            node = np.full(len(at), -1, np.int64)
            rows = np.flatnonzero(end[own] > begin[own])
            place, equal = words.successor(grams[at[rows], k].astype(np.uint64) + base[own[rows]])
            hit = equal & (place >= begin[own[rows]]) & (place < end[own[rows]])
            node[rows[hit]] = place[hit]
        return node[np.cumsum(step) - 1]

    def _arrays(self) -> list[np.ndarray]:
        return [*self.first.parts, *(a for level in self.levels for ef in level for a in ef.parts), self.codes, self.table]

    def to_bytes(self) -> bytes:
        """One flat buffer: the number of arrays, then for each its type, its length and its bytes, 8-aligned."""
        arrays = self._arrays()
        out = [np.array([len(arrays)], np.int64).tobytes()]
        for a in arrays:
            data = a.tobytes()
            out += [a.dtype.str.encode().ljust(8), np.array([a.size], np.int64).tobytes(), data, b"\0" * (-len(data) % 8)]
        return b"".join(out)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """A trie over a buffer, such as a memory-mapped file; nothing is copied."""
        raw = np.frombuffer(buffer, np.uint8) if not isinstance(buffer, np.ndarray) else buffer
        at, arrays = 8, []
        for _ in range(int(raw[:8].view(np.int64)[0])):
            kind = np.dtype(bytes(raw[at : at + 8]).decode().strip())
            n = int(raw[at + 8 : at + 16].view(np.int64)[0])
            arrays.append(raw[at + 16 : at + 16 + n * kind.itemsize].view(kind))
            at += 16 + n * kind.itemsize + -(n * kind.itemsize) % 8
        efs = [EliasFano(*arrays[i : i + 5]) for i in range(0, len(arrays) - 2, 5)]
        return cls(efs[0], list(zip(efs[1::2], efs[2::2], strict=True)), arrays[-2], arrays[-1])

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls.from_buffer(np.memmap(path, np.uint8, "r"))
