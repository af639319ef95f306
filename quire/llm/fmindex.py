"""A compressed full-text index of many strings, through which strings are streamed backward.

The Burrows-Wheeler transform of all strings stands in a wavelet matrix of packed bits with counts
per word. Besides it there are the places of every SAMPLE-th suffix, and two bits a suffix that
mark the classes of suffixes with the same first `least` - 1 characters; neither the texts nor the
suffix array are kept.

A string is read from its end. Backward search puts the next character before the `least` - 1 ones
read last: the interval holds every suffix that begins with these `least` characters. Then the last
of them is forgotten by going over to the class of the interval, and the next character follows. So
the matching statistics of each place, bounded by `least`, come out with the interval of the match.
All strings take their steps together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ONE = np.uint64(1)
#: One suffix in so many keeps its place.
SAMPLE = 16


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        padded = np.zeros((n // 64 + 1) * 8, np.uint8)
        padded[: len(raw)] = raw
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        w = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The bit at each position."""
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & _ONE).astype(bool)


class Index:
    """FM-index of different strings given as code points with bounds, for matches of `least` characters."""

    def __init__(self, cp: np.ndarray, bounds: np.ndarray, least: int):
        size = np.diff(bounds)
        k = len(size)
        self.least, self.size = least, size
        self.alphabet = np.unique(cp)
        # symbol 0 ends each string; it stands before all characters and equals nothing in a pattern
        n = self.n = len(cp) + k
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        self.starts = bounds[:-1] + np.arange(k)
        inside[self.starts + size] = False
        text[inside] = np.searchsorted(self.alphabet, cp) + 1
        sigma = len(self.alphabet) + 1
        order, key, wide = suffix_order(text, sigma)
        marked = order % SAMPLE == 0
        self.marked, self.sample = Bits(marked), (order[marked] // SAMPLE).astype(np.int32)
        same = _same(order, key, wide, sigma, least - 1)
        begin = ~same
        begin[:-1] &= same[1:]
        begin[-1:] = False
        self.same, self.begin = Bits(same), Bits(begin)
        # only classes of several suffixes are written down
        self.class_lo = np.flatnonzero(begin).astype(np.int32)
        single = np.append(np.flatnonzero(~same), n)
        self.class_hi = single[np.searchsorted(single, self.class_lo, side="right")].astype(np.int32)
        bwt = text[order - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(sigma + 1))
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            on = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(on)))
            bwt = np.concatenate([bwt[~on], bwt[on]])
        # where the block of each symbol begins after the last level
        base = np.arange(sigma)
        at = np.zeros(sigma, np.int64)
        for bit, bits in self.levels:
            ones = bits.ones(at).astype(np.int64)
            at = np.where(base >> bit & 1, bits.zeros + ones, at - ones)
        self.base = at

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        """The symbols of code points, -1 for those that don't occur."""
        if not len(self.alphabet):
            return np.full(len(cp), -1)
        i = np.minimum(np.searchsorted(self.alphabet, cp), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == cp, i + 1, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before position i."""
        at = i.astype(np.int64)
        for bit, bits in self.levels:
            ones = bits.ones(at).astype(np.int64)
            at = np.where(symbol >> bit & 1, bits.zeros + ones, at - ones)
        return at - self.base[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more character before them."""
        m = len(symbol)
        r = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.first[symbol] + r[:m], self.first[symbol] + r[m:]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `least` - 1 characters of patterns of `least`."""
        several = np.flatnonzero(self.same.get(lo) | self.begin.get(lo))
        k = self.begin.ones(lo[several] + 1) - 1
        lo, hi = lo.copy(), hi.copy()
        lo[several], hi[several] = self.class_lo[k], self.class_hi[k]
        return lo, hi

    def before(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, row): the character before each suffix, and the suffix that begins with it."""
        at, symbol = row.astype(np.int64), np.zeros(len(row), np.int64)
        for bit, bits in self.levels:
            on, ones = bits.get(at), bits.ones(at).astype(np.int64)
            at = np.where(on, bits.zeros + ones, at - ones)
            symbol |= on.astype(np.int64) << bit
        return symbol, self.first[symbol] + at - self.base[symbol]

    def places(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of each suffix, by steps back to the next one that keeps its place."""
        at, out = row.astype(np.int64), np.zeros(len(row), np.int64)
        live, step = np.arange(len(row)), 0
        while len(live):
            known = self.marked.get(at[live])
            hit = live[known]
            out[hit] = self.sample[self.marked.ones(at[hit])].astype(np.int64) * SAMPLE + step
            live = live[~known]
            at[live] = self.before(at[live])[1]
            step += 1
        s = np.searchsorted(self.starts, out, side="right") - 1
        return s, out - self.starts[s]

    def stream(self, symbol: np.ndarray, end: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(step, lo, hi) for each step from `least` on: the intervals of the `least` characters that begin `step` before each end.

        The strings symbol[end - size:end] stand in the index, the longest first; lo and hi are
        those of the first strings, which are at least `step` long.
        """
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            k = int(np.searchsorted(-size, -step, side="right"))
            lo, hi = self.extend(symbol[end[:k] - step], lo[:k], hi[:k])
            if step >= self.least:
                yield step, lo, hi
                lo, hi = self.shorten(lo, hi)


def _same(order: np.ndarray, key: np.ndarray, wide: int, sigma: int, depth: int) -> np.ndarray:
    """Whether each suffix has the same first `depth` symbols as the one before it in order."""
    n = len(order)
    same = np.zeros(n, bool)
    live = np.arange(1, n)
    if depth < wide:
        bits = max(1, int(sigma - 1).bit_length())
        short = key >> (bits * (wide - depth))
        live = live[short[order[live - 1]] == short[order[live]]]
    else:
        for at in [*range(0, depth - wide, wide), depth - wide]:
            live = live[key[(order[live - 1] + at) % n] == key[(order[live] + at) % n]]
    same[live] = True
    return same


def suffix_order(text: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, key, wide): the suffixes of text, as a ring, in order; key packs the `wide` symbols from each place on.

    Packed symbols are sorted first; then the ranks of suffixes that are still tied are doubled.
    """
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    wide = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(wide):
        key = key << bits | np.roll(text, -k)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    ordered = key[order]
    new[1:] = ordered[1:] != ordered[:-1]
    # the rank of a tied group is its first position, so that it stays while others are refined
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    done = wide
    while done < 2 * n:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        suffix = order[tied]
        group = rank[suffix]
        nxt = rank[(suffix + done) % n]
        o = np.lexsort((nxt, group)) if n > 1 << 31 else np.argsort(group * np.int64(n) + nxt, kind="stable")
        suffix, group, nxt = suffix[o], group[o], nxt[o]
        order[tied] = suffix
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        new[tied] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, tied, 0))
        done *= 2
    return order, key, wide
