"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, and merges by heap for the rest.

The vocabulary of a rank file goes into a minimal perfect hash (hash, displace and compress: keys in buckets, large
buckets first, each with the first displacement that sends its keys to free slots; as many slots as keys). A pre-token
that is a token resolves there by one vectorised probe and a comparison of bytes. Every other pre-token becomes a
linked list of bytes whose adjacent pairs lie in a heap by rank and position; the smallest merges until none is left.

Edge cases: null and empty texts have no ids and decode to no bytes. Unpaired surrogates cannot occur in Parquet
strings. Equal texts get equal ids. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .pieces import Memo
from .words import batches, mix, tidy

_U = np.uint64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def string_hashes(strings: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, eight bytes a step over all strings at once."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    h = mix(sizes.astype(_U) + _U(0x9E3779B97F4A7C15))
    order = np.argsort(-sizes, kind="stable")
    widths = -(-sizes // 8) * 8
    begin = np.cumsum(widths) - widths
    data = np.frombuffer(b"".join(x.ljust(w, b"\0") for x, w in zip(strings, widths.tolist(), strict=True)), "<u8")
    step, live = 0, order[: np.count_nonzero(sizes > 0)]
    while len(live):
        h[live] = mix(h[live] ^ data[begin[live] // 8 + step])
        step += 1
        live = live[: np.count_nonzero(sizes[live] > 8 * step)]
    return h


class PerfectHash:
    """Minimal: ``n`` keys have slots 0 to n - 1. ``find`` gives values, or -1 for what is no key."""

    def __init__(self, values: dict[bytes, int], per_bucket: int = 4):
        keys = list(values)
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        h = string_hashes(keys)
        bucket = (h >> _U(32)) % _U(self.buckets)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        self.shift = np.zeros(self.buckets, np.uint32)
        taken, slots = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            own, d = h[members[b]], 0
            while True:  # tries displacements in blocks
                tries = np.arange(d, d + 64, dtype=_U)
                at = self._slot(own[None, :], tries[:, None])
                good = ~taken[at].any(axis=1)
                if at.shape[1] > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = d + k
                    taken[at[k]] = True
                    slots[members[b]] = at[k]
                    break
                d += 64
        self.keys: list[bytes] = [b""] * self.n
        self.values = np.zeros(self.n, np.int64)
        for i, s in enumerate(slots.tolist()):
            self.keys[s] = keys[i]
            self.values[s] = values[keys[i]]

    def _slot(self, h, d):
        return (mix(h + d * _U(0x9E3779B97F4A7C15)) % _U(max(1, self.n))).astype(np.int64)

    def find(self, strings: list[bytes]) -> list[int]:
        if not strings or not self.n:
            return [-1] * len(strings)
        h = string_hashes(strings)
        at = self._slot(h, self.shift[((h >> _U(32)) % _U(self.buckets)).astype(np.int64)].astype(_U)).tolist()
        values = self.values[at].tolist()
        return [v if self.keys[s] == x else -1 for x, s, v in zip(strings, at, values, strict=True)]


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids after merging the pair of least rank, leftmost first, for as long as there is one.

    ``due[i]`` is the rank of the part at i with the part behind it, or -1; what the heap has of other ranks is stale.
    """
    n, get = len(token), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    due = [get(token[i : i + 2], -1) for i in range(n - 1)]
    due.append(-1)
    heap = [r * n + i for i, r in enumerate(due) if r >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        if due[i] != rank:
            continue
        j = after[i]
        k = after[i] = after[j]
        due[i] = due[j] = -1
        if k < n:
            before[k] = i
            due[i] = r = get(token[i : after[k]], -1)
            if r >= 0:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0:
            due[h] = r = get(token[h:k], -1)
            if r >= 0:
                heapq.heappush(heap, r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.memo = Memo(self._pieces, 500_000)

    def _pieces(self, pieces: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        cuts = [self.find(p) for p in pieces]
        distinct = list({x for c in cuts for x in c})
        raw = [x.encode() for x in distinct]
        known = {x: [v] if v >= 0 else merge(y, self.ranks) for x, y, v in zip(distinct, raw, self.whole.find(raw), strict=True)}
        found = [known[c[0]] if len(c) == 1 else [i for x in c for i in known[x]] for c in cuts]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at = self.memo.texts(texts)
        data = ids.astype("<u4").tobytes()
        return [data[4 * b : 4 * e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, kept between tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit; null unless ``with_ids``), and the digests of the ids and of the
    bytes they decode to."""
    ship(docs.sparkSession)

    def run(tables):
        c = codec(path, pattern)
        for t in tables:
            for texts, doc_ids in batches(t, ["text", "doc_id"]):
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, *vocabulary(), with_ids=False).drop("ids")
