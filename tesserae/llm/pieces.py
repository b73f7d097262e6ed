"""Cuts texts where every pre-tokeniser of the byte-level kind cuts too, so that pieces can be encoded once and kept.

The patterns in question never match white space after other characters, nor other characters after letters; of a run of
white space they leave the last space to the word behind it. So there is a cut between two matches before each space
that a non-space follows, and between an ASCII letter and ASCII punctuation or a line feed behind it. Encoding the
pieces one by one gives the ids of the whole text.

Pieces are found, hashed (128 bits) and looked up by numpy over the bytes of many texts at once; only pieces never seen
before are cut out as strings and encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import _BYTES, _U, _grow, _powers, encode, mix

_OTHER = mix(_BYTES ^ _U(0x2545F4914F6CDD1D))
_LETTER, _END, _SOLID, _BLANK = (np.zeros(256, bool) for _ in range(4))
_LETTER[65:91] = _LETTER[97:123] = True
_END[[10, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SOLID[33:127] = True  # surely no white space; neither are leads of characters outside the blocks that have some
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True  # perhaps white space


def cuts(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. ``first``: where texts do, those that are not empty."""
    at = np.zeros(len(a), bool)
    at[:-1] = (a[:-1] == 32) & _SOLID[a[1:]]
    at[first[1:] - 1] = False  # what follows such a space is another text
    at[1:] |= _LETTER[a[:-1]] & _END[a[1:]]
    at[first] = True
    return np.flatnonzero(at)


class Memo:
    """Ids of pieces, by hash. ``encode`` takes pieces, and of each whether it holds no white space but one leading
    space, and gives ids and their counts. Beyond ``most`` pieces only those of the batch at hand stay, so memory is
    bounded."""

    def __init__(self, encode: Callable[[list[str], list[bool]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.hash, self.check = np.zeros(0, _U), np.zeros(0, _U)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1024, np.uint32), 0

    def _keep(self, at, hashes, checks, ids, counts) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(ids)) + 1024, np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.hash, self.check = np.insert(self.hash, at, hashes), np.insert(self.check, at, checks)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, counts)

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and offsets: text k's are ``ids[offsets[k]:offsets[k + 1]]``. None counts as empty."""
        raw = encode(texts)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        data = b"".join(raw)
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(raw) + 1, np.int64)
        a = np.frombuffer(data, np.uint8)
        start = cuts(a, (ends - sizes)[sizes > 0])
        end = np.append(start[1:], len(a))
        _grow(len(a))
        h = []
        for table in (_BYTES, _OTHER):
            sums = np.zeros(len(a) + 1, _U)
            np.cumsum(table[a] * _powers[0][: len(a)], out=sums[1:])
            h.append(mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(_U)))
        distinct, where, inverse = np.unique(h[0], return_index=True, return_inverse=True)
        checks = h[1][where]
        at = np.searchsorted(self.hash, distinct)
        near = np.minimum(at, max(0, len(self.hash) - 1))
        hit = self.hash[near] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
        if (checks[inverse] != h[1]).any() or (self.check[near[hit]] != checks[hit]).any():  # 64 bits collide
            return self._alone(raw)
        if len(self.hash) + np.count_nonzero(~hit) > self.most:
            k = near[hit]
            counts = self.count[k]
            ids = self.ids[_spread(self.begin[k], counts)]
            self._clear()
            self._keep(np.zeros(len(k), np.int64), distinct[hit], checks[hit], ids, counts)
            at = np.searchsorted(self.hash, distinct)
        if not hit.all():
            new = np.flatnonzero(~hit)
            blanks = np.zeros(len(a) + 1, np.int32)
            np.cumsum(_BLANK[a], out=blanks[1:])
            b, e = start[where[new]], end[where[new]]
            plain = (blanks[e] - blanks[b] == (a[b] == 32)).tolist()
            ids, counts = self.encode([data[i:j].decode("utf-8", "surrogatepass") for i, j in zip(b.tolist(), e.tolist(), strict=True)], plain)
            self._keep(at[new], distinct[new], checks[new], ids, counts)
        k = np.searchsorted(self.hash, distinct)[inverse]
        counts = self.count[k]
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], ends])
        return self.ids[_spread(self.begin[k], counts)], total[np.searchsorted(start, bounds)]

    def _alone(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encode([x.decode("utf-8", "surrogatepass") for x in raw], [False] * len(raw))
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices begin, begin + 1 and so on, ``counts`` of each."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
