"""A compressed FM-index over word sequences: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class WaveletMatrix:
    """Rank queries on a sequence of small integers, one packed bit vector for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        at = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view("<u8")
            sums = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=sums[1:])
            self.words.append(packed)
            self.blocks.append(sums.astype(np.int32))
            self.zeros.append(len(bit) - int(sums[-1]))
            at = np.concatenate([at[~bit], at[bit]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            ones = self.blocks[k][at] + np.bitwise_count(self.words[k][at] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self._walk(symbol, i) - self.base[symbol]


def prefix_ranks(text: np.ndarray) -> list[np.ndarray]:
    """Dense ranks of all suffixes by their first 1, 2, 4, 8, 16 and 32 symbols, by prefix doubling; beyond the end is smallest."""
    out = [text.astype(np.int64)]
    for shift in (1, 2, 4, 8, 16):
        rank = out[-1]
        later = np.zeros(len(rank), np.int64)
        if shift < len(rank):
            later[: len(rank) - shift] = rank[shift:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key)
        ordered = key[order]
        now = np.empty(len(key), np.int64)
        now[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])[: len(key)])
        out.append(now)
    return out


def common_prefixes(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Symbols, up to 31, that each suffix in ``order`` shares with the one before it."""
    n = len(order)
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), np.int64)
    for power in range(4, -1, -1):
        i, j = a + shared, b + shared
        inside = (i < n) & (j < n)
        same = inside & (ranks[power][np.minimum(i, n - 1)] == ranks[power][np.minimum(j, n - 1)])
        shared += same << power
    return np.concatenate([np.zeros(min(n, 1), np.int64), shared]).astype(np.uint8)


class FMIndex:
    """FM-index of sequences joined by the separator 0, for matches of up to ``depth`` symbols.

    What stays is the Burrows-Wheeler transform in a wavelet matrix, the symbol counts, and where the
    suffixes' first ``depth`` symbols change; text and ranks are dropped.  Suffixes are sorted by their
    first 32 symbols, which backward search over at most 31 needs.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        if not 1 <= depth <= 30:
            raise ValueError("depth must be between 1 and 30")
        n, self.depth = len(text), depth
        ranks = prefix_ranks(text)
        order = np.argsort(ranks[-1] * n + np.arange(n))
        new = common_prefixes(ranks, order) < depth
        self.starts = np.append(np.flatnonzero(new), n).astype(np.int32)
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.count = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.count[1:])
        self.n = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol + pattern."""
        m = len(symbol)
        ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        at = self.count[symbol]
        return at + ranks[:m], at + ranks[m:]

    def find(self, stream: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of stream[start : start + length] for each pair; that of no symbols is everything."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        for k in range(int(length.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero((length > k) & (low < high))
            low[live], high[live] = self.step(stream[start[live] + k], low[live], high[live])
        return low, high

    def matching_statistics(self, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of some sequences, how long a prefix of the rest of its sequence occurs in the index, up to ``depth``, and its interval.

        Sequence s is stream[first[s] : first[s + 1]]; symbols that the index does not know are -1.  All
        sequences are streamed together from right to left: a match grows by a step of backward search;
        one longer than ``depth`` is cut to it, which widens its interval; one that cannot grow shrinks to
        the longest prefix that occurs, found by halving.
        """
        total = len(stream)
        lengths, lows, highs = np.zeros(total, np.uint8), np.zeros(total, np.int32), np.full(total, self.n, np.int32)
        live = np.flatnonzero(np.diff(first))
        at = first[1:][live] - 1
        low, high, length = np.zeros(len(live), np.int64), np.full(len(live), self.n), np.zeros(len(live), np.int64)
        while len(live):
            symbol = stream[at]
            known = symbol >= 0
            new_low, new_high = self.step(np.maximum(symbol, 0), low, high)
            length = length + 1
            lost = np.flatnonzero(~known | (new_low >= new_high))
            if len(lost):
                shortest, longest = np.zeros(len(lost), np.int64), np.where(known[lost], length[lost] - 1, 0)
                while (shortest < longest).any():
                    half = (shortest + longest + 1) // 2
                    a, b = self.find(stream, at[lost], half)
                    shortest, longest = np.where(a < b, half, shortest), np.where(a < b, longest, half - 1)
                length[lost] = shortest
                new_low[lost], new_high[lost] = self.find(stream, at[lost], shortest)
            low, high = new_low, new_high
            cut = np.flatnonzero(length >= self.depth)
            group = self.group[low[cut]]
            low[cut], high[cut], length[cut] = self.starts[group], self.starts[group + 1], self.depth
            lengths[at], lows[at], highs[at] = length, low, high
            more = at > first[:-1][live]
            live, at, low, high, length = live[more], at[more] - 1, low[more], high[more], length[more]
        return lengths, lows, highs
