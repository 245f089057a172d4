"""A compressed full-text index over word sequences: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Everything is vectorised over streams: many streams advance one word a step, each step two rank queries per level of the matrix.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Wavelet:
    """Symbols by bit levels; each level is a packed bit vector with counts before each 64-bit word."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.n, self.depth = len(x), max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        cur = x
        for level in range(self.depth - 1, -1, -1):
            bit = (cur >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            w = np.zeros(len(x) // 64 + 1, np.uint64)
            w.view(np.uint8)[: len(packed)] = packed
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))[:-1]]).astype(np.uint32))
            self.zeros.append(int(len(x) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # where each symbol's run starts after the last level
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            at = i >> 6
            ones = self.before[k][at] + np.bitwise_count(self.words[k][at] & ((_ONE << (i & 63).astype(np.uint64)) - _ONE))
            i = np.where((c >> (self.depth - 1 - k)) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        return self._walk(c, i) - self.base[c]


class FMIndex:
    """Of segments (arrays of symbols 1 to sigma - 1), each with a document number.

    ``threshold``: the match length at which an interval's smallest document is asked for.
    """

    def __init__(self, segments: list[np.ndarray], docs: np.ndarray, sigma: int, threshold: int):
        m = len(segments)
        lens = np.fromiter(map(len, segments), np.int64, m)
        n = int(lens.sum()) + m
        sym, owner = np.zeros(n, np.int64), np.repeat(docs, lens + 1)
        ends = np.cumsum(lens + 1) - 1
        words = np.ones(n, bool)
        words[ends] = False
        sym[words] = np.concatenate(segments)
        # each segment's end is a symbol of its own, so suffixes differ within a segment's length
        rank = sym + m
        rank[ends] = np.arange(m)
        self.threshold, self.n = threshold, n
        depth, half, half_depth = 1, rank, 1
        longest = int(lens.max()) + 1
        while True:
            if depth <= threshold:
                half, half_depth = rank, depth
            if depth >= longest:
                break
            nxt = np.full(n, -1, np.int64)
            nxt[: n - depth] = rank[depth:] if depth < n else nxt[: n - depth]
            key = rank * (int(rank.max()) + 2) + nxt + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            depth *= 2
            if rank[order[-1]] == n - 1 and depth > threshold:
                break
        sa = np.argsort(rank, kind="stable")
        # suffixes that share their first ``threshold`` words
        a = half[sa]
        b_at = sa + threshold - half_depth
        b = np.where(b_at < n, half[np.minimum(b_at, n - 1)], -1)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        start = np.flatnonzero(new)
        self.cls = np.cumsum(new) - 1
        self.cls_lo = start
        self.cls_hi = np.append(start[1:], n)
        self.least = np.minimum.reduceat(owner[sa], start)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=sigma))])
        self.bwt = Wavelet(sym[sa - 1], sigma)

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c before what lo to hi matches."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        k = len(c)
        return self.first[c] + both[:k], self.first[c] + both[k:]

    def matches(self, streams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each stream, the starts at which ``threshold`` words or more match, and the smallest document that has those words.

        Streams are read right to left. The match kept is the longest up to ``threshold`` words; where the next word can't
        precede it, the match gives up its last word and is searched again.
        """
        n = len(streams)
        lens = np.fromiter(map(len, streams), np.int64, n)
        flat = np.concatenate([*streams, np.zeros(1, np.int64)])
        off = np.cumsum(lens) - lens
        j, size = lens - 1, np.zeros(n, np.int64)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n)
        live = np.flatnonzero(j >= 0)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        T = self.threshold
        while len(live):
            c = flat[off[live] + j[live]]
            a, b = self.step(lo[live], hi[live], c)
            ok = b > a
            s, bad = live[ok], live[~ok]
            lo[s], hi[s] = a[ok], b[ok]
            size[s] += 1
            full = s[size[s] >= T]
            if len(full):
                k = self.cls[lo[full]]
                lo[full], hi[full], size[full] = self.cls_lo[k], self.cls_hi[k], T
                got.append((full, j[full], self.least[k]))
            j[s] -= 1
            # a word that nothing has: go on before it; else search again from one word less on the right
            none = bad[size[bad] == 0]
            j[none] -= 1
            rest = bad[size[bad] > 0]
            j[rest] += size[rest] - 1
            lo[bad], hi[bad], size[bad] = 0, self.n, 0
            live = live[j[live] >= 0]
        if not got:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        who, at, least = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((at, who))
        who, at, least = who[order], at[order], least[order]
        # a start is met once for the longest match and maybe again after giving up words; all agree
        cut = np.searchsorted(who, np.arange(n + 1))
        return [(at[x:y], least[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
