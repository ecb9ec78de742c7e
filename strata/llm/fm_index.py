"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet matrix, searched backwards
for many patterns at once.

Suffixes are sorted by their first CONTEXT symbols, which is exact for patterns up to that length. Beside the
bit vectors with their rank directory there is the least text place of each block of the suffix array, so
that a search can tell whether an occurrence lies before a given place.
"""

from __future__ import annotations

import numpy as np

CONTEXT = 32


class WaveletMatrix:
    """Counts of a symbol before places of a sequence; a bit vector for each bit of the symbols, highest first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        n = len(seq)
        self.words, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1 << 3, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        # where each symbol's run begins in the order of the last level
        edge = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if n else np.zeros(0, np.int64)
        self.first = np.zeros(symbols, np.int64)
        self.first[seq[edge]] = edge

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of symbol c[k] stand before at[k]."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.sums[k][word] + np.bitwise_count(self.words[k][word] & low)
            bit = (c >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at - self.first[c]


class FmIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 1; 0 is put between what mustn't run together, and stands at its end."""
        n = len(text)
        rank = text.astype(np.int64)
        reach = 1
        while True:  # each step doubles the symbols that are sorted by
            ahead = np.zeros(n, np.int64)
            ahead[:n - reach] = rank[reach:]
            key = rank * (int(rank.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            reach *= 2
            if reach >= CONTEXT or (n and new[-1] == n - 1):
                break
        self.n, self.text = n, text
        symbols = int(text.max(initial=0)) + 1
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1].astype(np.int64), symbols)
        self.least = [order.astype(np.int32)]  # least[k][j]: the least place of 2 ** k entries from j
        while 2 << len(self.least) - 1 <= n:
            half, below = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(below[:-half], below[half:]) if half < len(below) else below)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with c and go on like those of the given ranges."""
        both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.counts[c]
        return base + both[:len(c)], base + both[len(c):]

    def first_place(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least text place of each range of suffixes (none is empty)."""
        out = np.empty(len(lo), np.int64)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for level in np.unique(k).tolist():
            on = np.flatnonzero(k == level)
            table = self.least[level]
            out[on] = np.minimum(table[lo[on]], table[hi[on] - (1 << level)])
        return out


def repeated_windows(index: FmIndex, base: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """For each region of the text (from ``base``, ``windows`` windows of ``size`` words), which of its windows also
    stand earlier: bits, window 0 lowest. Matching statistics by backward search, all regions side by side."""
    n = len(base)
    out = np.zeros(n, np.int64)
    end = base + windows + size - 1
    target = base.copy()  # a search succeeds when it has come back to here
    whole = np.ones(n, bool)  # first try the region as one
    last = windows - 1  # last window that isn't decided
    at = end.copy()
    lo, hi = np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    live = np.arange(n)
    ones = lambda a, b: (np.int64(1) << np.maximum(b + 1, 0)) - (np.int64(1) << np.maximum(np.minimum(a, b + 1), 0))  # noqa: E731  bits a to b
    while len(live):
        c = index.text[at[live] - 1].astype(np.int64)
        x, y = index.extend(c, lo[live], hi[live])
        earlier = index.first_place(x, y) < at[live] - 1
        lo[live], hi[live] = x, y
        go = live[earlier]
        at[go] -= 1
        hit = go[at[go] == target[go]]
        miss = live[~earlier]
        f = at[miss] - 1 - base[miss]  # with this word there is no earlier occurrence
        again = []
        # the whole region stands earlier; or all of it after f
        w = hit[whole[hit]]
        out[w] |= ones(np.zeros(len(w), np.int64), windows[w] - 1)
        v = whole[miss]
        m, g = miss[v], f[v]
        out[m] |= ones(g + 1, windows[m] - 1)
        last[m] = np.minimum(g, windows[m] - 1) - (g >= windows[m] - 1)
        whole[m] = False
        begin = np.zeros(len(m), np.int64)
        again.append((m, begin))
        # single windows, from the left: a hit decides its window, a miss all that hold what has no earlier occurrence
        s = hit[~np.isin(hit, w)] if len(w) else hit
        i = target[s] - base[s]
        out[s] |= np.int64(1) << i
        again.append((s, i + 1))
        again.append((miss[~v], f[~v] + 1))
        who = np.concatenate([a for a, _ in again])
        nxt = np.concatenate([b for _, b in again])
        on = nxt <= last[who]
        who, nxt = who[on], nxt[on]
        target[who] = base[who] + nxt
        at[who] = target[who] + size
        lo[who], hi[who] = 0, index.n
        live = np.concatenate([go[at[go] != target[go]] if len(go) else go, who])
        live = np.unique(live)
    return out
