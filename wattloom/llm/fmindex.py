"""FM-index over words: wavelet matrix, backward search, and matches of a least length."""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits in words of 64 with a running count, 1.5 bits a bit; ``rank(i)`` counts the ones before i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    """The sequence's bits from the highest down, each level stably sorted by the bits above."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, RankBits(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate((sequence[~bits], sequence[bits]))
        every = np.arange(symbols)
        self.start = self._down(every, np.zeros((1, symbols), dtype=np.int64))[0]  # where a symbol's run starts on the last level

    def _down(self, symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the first level, several rows of one a symbol, on the last."""
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(ends)
            ends = np.where(symbol >> shift & 1, zeros + ones, ends - ones)
        return ends

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a symbol occurs before lo and before hi."""
        return tuple(self._down(symbol, np.stack((lo, hi))) - self.start[symbol])


class FMIndex:
    """Index of an array of symbols from 0, with suffixes sorted by their first ``depth`` symbols.

    Backward search is exact for patterns of up to ``depth`` symbols, as suffixes that agree so far need no order.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, h = text.astype(np.int64), 1
        self.ranks = [rank]  # equal where the next 1, 2, 4, ... symbols are
        while True:
            follow = np.zeros(n, dtype=np.int64)
            follow[: n - min(h, n)] = rank[h:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + follow
            self.order = np.argsort(key)
            ordered = key[self.order]
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            self.ranks.append(rank)
            h *= 2
            if h >= depth:
                break
        self.text = text
        self.bwt = WaveletMatrix(text[self.order - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        before, upto = self.bwt.ranks(symbol, lo, hi)
        return self.first[symbol] + before, self.first[symbol] + upto

    def common(self, length: int) -> np.ndarray:
        """Whether each suffix, in order, has the same first ``length`` symbols as the one before."""
        out = np.zeros(len(self.order), dtype=bool)
        fits = self.order + length <= len(self.text)
        pair = np.flatnonzero(fits[1:] & fits[:-1]) + 1
        a, b = self.order[pair - 1], self.order[pair]
        for k in range(len(self.ranks) - 1, -1, -1):
            if length >> k & 1:
                same = self.ranks[k][a] == self.ranks[k][b]
                pair, a, b = pair[same], a[same] + (1 << k), b[same] + (1 << k)
        out[pair] = True
        return out


class LeastOwner:
    """For substrings of exactly ``length`` symbols, the smallest owner of any occurrence in the indexed text.

    Intervals of that depth are the runs of suffixes with a common prefix of ``length``; each keeps its minimum.
    ``shrink`` widens an interval to the run of ``length - 1``, which is how a match loses its last symbol.
    """

    def __init__(self, index: FMIndex, owner: np.ndarray, length: int):
        self.index, self.length = index, length
        whole, short = index.common(length), index.common(length - 1)
        starts = np.flatnonzero(~whole)
        self.run = RankBits(~whole)
        self.least = np.minimum.reduceat(owner[index.order], starts) if len(starts) else owner
        self.short_starts = np.append(np.flatnonzero(~short), len(short))
        self.short_run = RankBits(~short)

    def shrink(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = self.short_run.rank(lo + 1).astype(np.int64) - 1
        return self.short_starts[run], self.short_starts[run + 1]

    def owners(self, lo: np.ndarray) -> np.ndarray:
        return self.least[self.run.rank(lo + 1).astype(np.int64) - 1]

    def match(self, patterns: np.ndarray, starts: np.ndarray, sizes: np.ndarray, none: int) -> np.ndarray:
        """For every place in the patterns, the least owner of the ``length`` symbols from there, else ``none``.

        All patterns are streamed together, from their last symbol back. A match that cannot be extended gives up
        its last symbols one at a time, so a pattern may have substrings that are not in the index.
        """
        out = np.full(len(patterns), none, dtype=np.int64)
        live = np.flatnonzero(sizes >= self.length)
        at = starts[live] + sizes[live] - 1  # next symbol to put in front
        end = at + 1  # the match is patterns[at + 1 : end]
        begin, n = starts[live], len(self.index.text)
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), n, dtype=np.int64)
        while len(at):
            new_lo, new_hi = self.index.extend(patterns[at], lo, hi)
            good = new_hi > new_lo
            # extended: a full match is reported and shortened by its last symbol
            lo, hi = np.where(good, new_lo, 0), np.where(good, new_hi, n)
            full = good & (end - at == self.length)
            out[at[full]] = self.owners(lo[full])
            lo[full], hi[full] = self.shrink(lo[full])
            # not found: no occurrence has the symbol before this match, so start anew with one symbol less at the end
            end = np.where(good, end - full, end - 1)
            at = np.where(good, at - 1, end - 1)
            keep = (at >= begin) & (end - begin >= self.length)
            at, end, begin, lo, hi = at[keep], end[keep], begin[keep], lo[keep], hi[keep]
        return out
