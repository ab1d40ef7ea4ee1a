"""Recompression of token sequences: rounds that name runs and pairs.

In a round maximal runs of one symbol are named, then every pair whose left symbol is of the left class and whose
right one is of the right class; a symbol's class is a bit of its own name and the round. A name is 128 bits made of
the names of what it stands for, down to the words', so equal strings get equal names in every document and round.
Each symbol carries its place and its context: the words that must be seen to know that the parse has this symbol
here. Wherever a context's words occur again, the symbol occurs again at the same distance. So a symbol that occurs
once in the whole corpus proves that every window around its context occurs once, and one that occurs twice proves
that every window inside it occurs twice.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: What a symbol is: known to be shared, named anew and not yet counted, or a fence: it occurs once, or is a text's border.
SHARED, FRESH, FENCE = 0, 1, 2


def stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer."""
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


class Parse:
    """Symbols of several texts side by side, each text between two border fences. Places count from a text's
    first word: a symbol of text `row` stands for the words start..end and its context is lo..hi; first and last
    are hashes of its border words."""

    FIELDS = ("row", "a", "b", "start", "end", "lo", "hi", "first", "last", "kind")
    __slots__ = FIELDS

    def __init__(self, **columns: np.ndarray):
        for f in self.FIELDS:
            setattr(self, f, columns[f])

    @classmethod
    def of_words(cls, texts: list[tuple[np.ndarray, np.ndarray]]) -> "Parse":
        """From the two hashes of each text's words."""
        n = np.array([len(a) for a, _ in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(n + 2)])
        total = int(at[-1])
        a, b = np.zeros(total, U), np.zeros(total, U)
        kind = np.full(total, FENCE, np.int8)
        for s, (x, y) in zip(at, texts):
            own = slice(s + 1, s + 1 + len(x))
            a[own], b[own], kind[own] = x, y, FRESH
        start = (np.arange(total) - np.repeat(at[:-1], n + 2) - 1).astype(np.int32)
        row = np.repeat(np.arange(len(n)), n + 2)
        word = (a & U(0x7FFF)).astype(np.int16)
        return cls(row=row, a=a, b=b, start=start, end=start + 1, lo=start, hi=start + 1, first=word, last=word, kind=kind)

    def take(self, at: np.ndarray) -> "Parse":
        return Parse(**{f: getattr(self, f)[at] for f in self.FIELDS})

    def runs(self) -> None:
        n = len(self.a)
        head = np.ones(n, bool)
        fence = self.kind == FENCE
        head[1:] = (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1]) | fence[1:] | fence[:-1]
        at = np.flatnonzero(head)
        last = np.append(at[1:], n) - 1
        many = last > at
        # that a run ends here is known from the word beside it if that differs from the run's own, else from the neighbour
        lo, hi = self.lo[at], self.hi[last]
        prev, nxt = np.maximum(at - 1, 0), np.minimum(last + 1, n - 1)
        s, e = self.start[at], self.end[last]
        left_clear, right_clear = self.last[prev] != self.last[at], self.first[nxt] != self.first[at]
        lo = np.where(fence[at], lo, np.minimum(lo, np.where(left_clear, s - 1, np.minimum(self.lo[prev], s - 1))))
        hi = np.where(fence[at], hi, np.maximum(hi, np.where(right_clear, e + 1, np.maximum(self.hi[nxt], e + 1))))
        new = self.take(at)
        new.end, new.last, new.lo, new.hi = e, self.last[last], lo, hi
        if many.any():
            count = (last[many] - at[many] + 1).astype(U)
            new.a[many] = stir(new.a[many] * _A + count * _C + U(3))
            new.b[many] = stir(new.b[many] * _C + count * _B + U(11))
            new.kind[many] = FRESH
        self._become(new)

    def pairs(self, salt: int, longest: int) -> None:
        n = len(self.a)
        fence = self.kind == FENCE
        right = (stir(self.a ^ stir(np.array([salt], U))) & U(1)).astype(bool)
        joins = np.zeros(n, bool)  # with the next
        joins[:-1] = ~right[:-1] & right[1:] & ~fence[:-1] & ~fence[1:] & (self.end[1:] - self.start[:-1] <= longest)
        taken = np.zeros(n, bool)
        taken[1:] = joins[:-1]
        lo, hi = self.lo.copy(), self.hi.copy()
        alone_l, alone_r = ~right & ~joins & ~fence, right & ~taken & ~fence
        nxt, prev = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        hi[alone_l] = np.maximum(hi[alone_l], self.hi[nxt[alone_l]])
        lo[alone_r] = np.minimum(lo[alone_r], self.lo[prev[alone_r]])
        p = np.flatnonzero(joins)
        lo[p] = np.minimum(self.lo[p], self.lo[p + 1])
        hi[p] = np.maximum(self.hi[p], self.hi[p + 1])
        at = np.flatnonzero(~taken)
        mine = np.flatnonzero(joins[at])
        new = self.take(at)
        new.lo, new.hi = lo[at], hi[at]
        new.a[mine] = stir(self.a[p] * _B + stir(self.a[p + 1] + _C) + U(7))
        new.b[mine] = stir(self.b[p] * _A + stir(self.b[p + 1] ^ _B) + U(13))
        new.end[mine], new.last[mine], new.kind[mine] = self.end[p + 1], self.last[p + 1], FRESH
        self._become(new)

    def _become(self, other: "Parse") -> None:
        for f in self.FIELDS:
            setattr(self, f, getattr(other, f))

    def rounds(self, first: int, n: int, longest: int) -> "Parse":
        """n rounds, numbered from `first`; pairs of more than `longest` words stay apart."""
        for k in range(first, first + n):
            if len(self.a):
                self.runs()
                self.pairs(k + 1, longest)
        return self

    def growing(self) -> np.ndarray:
        """Places of the shared symbols that have a shared neighbour, and of the fences beside those."""
        alive = np.concatenate([[False], self.kind == SHARED, [False]])
        grow = alive[1:-1] & (alive[:-2] | alive[2:])
        beside = np.concatenate([[False], grow, [False]])
        return np.flatnonzero(grow | (~alive[1:-1] & (beside[:-2] | beside[2:])))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").split()
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, w)), U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def window_hashes(a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the `size` words from each place, from the words' own two."""
    x, y = np.zeros(len(at), U), np.zeros(len(at), U)
    for k in range(size):
        x = x * _A + a[at + k]
        y = (y ^ b[at + k]) * _C
        y ^= y >> U(29)
    return stir(x), stir(y)
