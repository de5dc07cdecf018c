"""A compressed FM-index over sequences of words: suffix array, Burrows-Wheeler transform, entropy-coded wavelet tree.

The tree is shaped by Shannon codes, so it takes about the zero-order entropy of the words in bits; owners are kept as
small ranks with minima of blocks. Many backward searches run side by side as numpy lanes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. The last symbol must be the only smallest one."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """A bit vector with the ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view("<u8")
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.packed))].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.packed[word] & below)

    def nbytes(self) -> int:
        return self.packed.nbytes + self.ones.nbytes


class WaveletTree:
    """Ranks of symbols over a sequence. A symbol seen n times of N has a code of ceil(log2(N / n)) bits.

    Codes are canonical. Each level holds the symbols whose codes are longer, node by node; a node is a code's prefix,
    and the prefixes of a level's nodes are consecutive numbers.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        counts = np.bincount(symbols, minlength=sigma)
        bits = np.zeros(sigma, np.int64)
        used = np.flatnonzero(counts)
        bits[used] = np.maximum(1, np.ceil(np.log2(len(symbols) / counts[used]) - 1e-12)).astype(np.int64)
        self.depth = depth = int(bits.max(initial=1))
        by_bits = used[np.argsort(bits[used], kind="stable")]
        space = np.left_shift(1, depth - bits[by_bits])
        codes = np.zeros(sigma, np.int64)
        codes[by_bits] = np.cumsum(space) - space  # the first bits[k] of depth bits
        self.code, self.bits, self.counts = codes.astype(np.int32), bits.astype(np.int8), counts
        self.levels = []
        x, left = codes[symbols], bits[symbols]
        for level in range(depth):
            bit = (x >> (depth - level - 1)) & 1
            vector = Bits(bit)
            prefix = x >> (depth - level)
            starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            low = int(prefix.min())
            begin = np.zeros(int(prefix.max()) - low + 1, np.int32)
            begin[prefix[starts] - low] = starts
            before = vector.rank(begin.astype(np.int64)).astype(np.int32)
            self.levels.append((vector, low, begin, before))
            keep = left > level + 1
            zero, one = keep & (bit == 0), keep & (bit == 1)
            x, left = np.r_[x[zero], x[one]], np.r_[left[zero], left[one]]
            if not len(x):
                break

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs before position i[k]."""
        code, bits = self.code[c].astype(np.int64), self.bits[c]
        out = np.where(bits > 0, i, 0)
        at = np.flatnonzero(bits > 0)
        for level, (vector, low, begin, before) in enumerate(self.levels):
            if level:
                at = at[bits[at] > level]
            if not len(at):
                break
            here, k = out[at], code[at]
            node = (k >> (self.depth - level)) - low
            ones = vector.rank(begin[node] + here) - before[node]
            out[at] = np.where((k >> (self.depth - level - 1)) & 1, ones, here - ones)
        return out

    def nbytes(self) -> int:
        return sum(v.nbytes() + b.nbytes + o.nbytes for v, _, b, o in self.levels) + self.code.nbytes + self.bits.nbytes


class RangeMinima:
    """Smallest values of ranges: the values, and minima over runs of blocks that double in length."""

    BLOCK = 8

    def __init__(self, values: np.ndarray):
        size = self.BLOCK
        top = np.iinfo(values.dtype).max
        self.values = np.r_[values, np.full(-len(values) % size + size, top, values.dtype)]
        self.runs = [self.values.reshape(-1, size).min(axis=1)]
        while (half := 1 << (len(self.runs) - 1)) * 2 <= len(self.runs[0]):
            self.runs.append(np.minimum(self.runs[-1][:-half], self.runs[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value in each [lo[k], hi[k]); ranges are not empty."""
        size, top = self.BLOCK, np.iinfo(self.values.dtype).max
        steps = np.arange(size)
        head = lo[:, None] + steps
        out = np.where(head < hi[:, None], self.values[np.minimum(head, len(self.values) - 1)], top).min(axis=1)
        tail = hi[:, None] - 1 - steps
        out = np.minimum(out, np.where(tail >= lo[:, None], self.values[np.maximum(tail, 0)], top).min(axis=1))
        first, last = -(-lo // size), hi // size  # whole blocks between
        wide = np.flatnonzero(last > first)
        level = np.frexp((last - first)[wide].astype(float))[1] - 1
        for k in np.unique(level):
            at = wide[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.runs[k][first[at]], self.runs[k][last[at] - (1 << int(k))]))
        return out

    def nbytes(self) -> int:
        return self.values.nbytes + sum(r.nbytes for r in self.runs)


class FMIndex:
    """Backward search over pieces, each with an owner; an interval's smallest owner is found by range minima."""

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, sigma: int):
        """pieces hold symbols 2..sigma-1; 1 parts them and 0 ends the text."""
        bar = np.ones(1, np.int64)
        text = np.concatenate([*[x for p in pieces for x in (p, bar)], np.zeros(1, np.int64)])
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletTree(text[order - 1], sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))][:sigma]
        self.owners, ranks = np.unique(owners, return_inverse=True)
        lengths = [len(p) + 1 for p in pieces]
        self.minima = RangeMinima(np.r_[np.repeat(ranks, lengths), len(self.owners)][order].astype(np.int32))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c[k] before what the interval [lo[k], hi[k]) matches."""
        both = self.first[np.r_[c, c]] + self.wavelet.rank(np.r_[c, c], np.r_[lo, hi])
        return both[: len(c)], both[len(c) :]

    def rank_of(self, limit: np.ndarray) -> np.ndarray:
        """Owners below limit[k] are those whose rank is below this."""
        return np.searchsorted(self.owners, limit)

    def owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rank of the smallest owner in each interval; intervals are not empty."""
        return self.minima.least(lo, hi)

    def nbytes(self) -> int:
        return self.wavelet.nbytes() + self.minima.nbytes() + self.first.nbytes + self.owners.nbytes


def matched_windows(index: FMIndex, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, limits: np.ndarray, window: int) -> np.ndarray:
    """Marks the places of text where a window of `window` symbols begins that a piece with a smaller owner holds.

    Lane k walks text[begins[k]:ends[k]] from its end by backward search and keeps the longest match among owners below
    limits[k], its matching statistic. Where a match breaks, the walk resumes at the last end that still has an
    undecided window. Symbols below 2 match nothing.
    """
    hit = np.zeros(len(text), bool)
    lane = np.flatnonzero(ends - begins >= window)
    end, at = ends[lane].copy(), ends[lane].copy()
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    begin, limit = begins[lane], index.rank_of(limits[lane])
    while len(end):
        going = at > begin
        c = np.where(going, text[np.maximum(at - 1, 0)], 0)
        going &= c > 1
        new_lo, new_hi = index.extend(np.where(going, c, 2), lo, hi)
        going &= new_hi > new_lo
        some = np.flatnonzero(going)
        going[some] = index.owner(new_lo[some], new_hi[some]) < limit[some]
        lo, hi = np.where(going, new_lo, 0), np.where(going, new_hi, index.n)
        at = np.where(going, at - 1, at)
        long = going & (end - at >= window)
        hit[at[long]] = True
        end = np.where(going, end, np.minimum(end - 1, at + window - 1))
        at = np.where(going, at, end)
        left = end - begin >= window
        if not left.all():
            end, at, lo, hi, begin, limit = (x[left] for x in (end, at, lo, hi, begin, limit))
    return hit
