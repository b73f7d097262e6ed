"""Words and shingles of many texts at once, as 64-bit hashes, by numpy over the UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lower-cased. Hashes are polynomial prefix sums over a random byte table followed by a finaliser: every word costs a few
vector operations, none of them a Python call.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        n += n >> 3
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + 1, base, dtype=_U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)


def encode(texts: list) -> list[bytes]:
    """UTF-8 bytes; None counts as empty."""
    return [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets: document k's are ``h[offsets[k]:offsets[k + 1]]``."""
    sizes = np.fromiter((len(x) + 1 for x in raw), dtype=np.int64, count=len(raw))
    a = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(word, prepend=False))  # ends with a space, so edges come in pairs
    start, end = edge[::2], edge[1::2]
    _grow(len(a))
    sums = np.zeros(len(a) + 1, dtype=_U)
    np.cumsum(_BYTES[_LOWER[a]] * _powers[0][: len(a)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(_U))
    return h, np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))


def shingle_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    """For each document its distinct shingles of ``width`` words, as sorted hashes. With fewer words, the whole
    sequence is the one shingle; without words, the set is empty."""
    h, at = word_hashes(raw)
    n = max(0, len(h) - width + 1)
    s = h[:n].copy() if n else h[:0]
    for j in range(1, width):
        s = mix(s * _M2 + h[j : n + j])
    out = []
    for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - b >= width:
            x = np.sort(s[b : e - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif e > b:
            x = h[b : b + 1]
            for j in range(b + 1, e):
                x = mix(x * _M2 + h[j : j + 1])
            out.append(mix(x + _U(e - b)))
        else:
            out.append(h[:0])
    return out


def tidy(run):
    """``run``, a function of Arrow batches, with memory given back to the system behind it: workers live on between
    tasks, and what one task needed at its peak should not weigh on the next."""

    def tidied(tables):
        yield from run(tables)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return tidied


def batches(table, columns: list[str], at_most: int = 1 << 20, texts: int = 1):
    """Splits an Arrow batch into lists of rows whose texts, the first of ``columns``, sum up to about ``at_most``
    bytes, so that memory follows the longest text and not the batch."""
    data = [table.column(table.schema.get_field_index(c)).to_pylist() for c in columns]
    begin, size = 0, 0
    for k, found in enumerate(zip(*data[:texts], strict=True)):
        size += sum(len(x or "") for x in found)
        if size >= at_most or k == len(data[0]) - 1:
            yield [x[begin : k + 1] for x in data]
            begin, size = k + 1, 0
