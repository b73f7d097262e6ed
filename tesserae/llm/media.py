"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy, area-resized and written as NPY tiles.

``decode`` reads P1 to P6 (bilevel, grey and RGB; 8 and 16 bit) and uncompressed BMP (1, 4, 8, 24 and 32 bit).
``resize`` averages over exact fractional areas with an integral image. ``features`` maps a table with a binary column
to tiles (NPY bytes) and 64-bit difference hashes; a row whose bytes are no readable image, or null, gets null features
and the reason in ``error``.

Edge cases: a null text is an empty one, whose payload is 64 zero bytes. Ties and repeated rows are rows like any other.
An empty table gives an empty result. Extra columns of the input are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import Scratch
from .words import batches, encode, tidy

WIDTH = 64  # of the grey images that payload_to_media makes
TILE = 16  # side of the NPY tiles

_HEADER = re.compile(rb"P([1-6])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm header")
    kind, w, h, at = int(m[1]), int(m[3]), int(m[5]), m.end()
    most = 1
    if kind not in (1, 4):
        m = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)").match(data, at)
        most, at = int(m[1]), m.end()
    if w < 1 or h < 1 or not 0 < most < 65536:
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        return (1 - bits).astype(np.uint8) * np.uint8(255)
    if kind < 4:
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array([c - 48 for c in text if c in b"01"] if kind == 1 else text.split(), dtype=np.int64)[:n]
        if len(flat) < n:
            raise ValueError("truncated Netpbm data")
        if kind == 1:
            return ((1 - flat) * 255).astype(np.uint8).reshape(h, w)
        flat = flat.astype(np.uint8 if most < 256 else np.uint16)
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    head, w, h, _, depth, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    row, rows = (w * depth + 31) // 32 * 4, abs(h)
    raw = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    if h > 0:
        raw = raw[::-1]
    if depth >= 24:
        return raw[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1].copy()
    if depth == 8:
        index = raw[:, :w]
    else:
        bits = np.unpackbits(raw, axis=1)
        index = bits[:, :w] if depth == 1 else (np.packbits(bits.reshape(rows, -1, 4), axis=2)[:, :, 0] >> 4)[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    grey = used == 256 and bool((palette == np.arange(256, dtype=np.uint8)[:, None]).all())
    return index.copy() if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3 samples. Raises ValueError for what it cannot read."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        return _netpbm(data)
    except (struct.error, IndexError, TypeError) as e:
        raise ValueError(f"unreadable image: {e}") from e


def encode_pgm(a: np.ndarray) -> bytes:
    """Binary PGM (P5) of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """Bottom-up BMP: 8-bit grey with an identity palette, or 24-bit RGB."""
    h, w = a.shape[:2]
    palette = b"" if a.ndim == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()
    body = a[::-1, :, ::-1].reshape(h, w * 3) if a.ndim == 3 else a[::-1]
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4)))
    start = 54 + len(palette)
    return (
        struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
        + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if a.ndim == 3 else 8, 0, body.size, 2835, 2835, len(palette) // 4, 0)
        + palette
        + body.astype(np.uint8).tobytes()
    )


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a grid of equal areas, fractional pixels included, from the integral image."""
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1), dtype=np.float64)
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    for axis, (n, m) in enumerate(zip(a.shape, (height, width), strict=True)):
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None] if axis == 0 else at - low
        below, above = np.take(total, low, axis), np.take(total, low + 1, axis)
        total = below + (above - below) * part
    area = (a.shape[0] / height) * (a.shape[1] / width)
    return (total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]) / area


def tile_bytes(a: np.ndarray, side: int = TILE) -> bytes:
    """The area-resized grey tile as NPY bytes."""
    out = io.BytesIO()
    np.save(out, np.rint(resize(grey(a), side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(a: np.ndarray) -> str:
    """64 bits, one for each rise between neighbours of the 8 x 9 thumbnail, as hex."""
    small = np.rint(resize(grey(a), 8, 9) * 256).astype(np.int64)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def payload(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH or (WIDTH if not raw else 0))


def texts_to_media(docs: DataFrame, image_format: str = "both") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, zero-padded to whole rows of 64, as a grey image. "both" makes a BMP
    of texts with an odd checksum and a PGM of the others, so equal texts have equal images."""
    makes = {"pgm": (encode_pgm,) * 2, "bmp": (encode_bmp,) * 2, "both": (encode_pgm, encode_bmp)}[image_format]
    ship(docs.sparkSession)

    def run(tables):
        for t in tables:
            for texts, ids in batches(t, ["text", "doc_id"]):
                raw = encode(texts)
                media = [makes[zlib.crc32(x) & 1](np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """``keys`` and, from the bytes in ``media``: height, width, channels, the samples' size, SHA-256 and checksum of
    the last 64, the stored form's size and SHA-256, the NPY tile and the difference hash; or ``error``."""
    ship(media.sparkSession)
    fields = media.select(*keys).schema
    made = "height int, width int, channels int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string, error string"
    names = [x.split()[0] for x in made.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def one(data):
        if data is None:
            return (None,) * 10 + ("null",)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            a = decode(data)
        except ValueError as e:
            return (None,) * 6 + (*stored, None, None, str(e))
        raw = a.tobytes()
        return (*a.shape[:2], a.shape[2] if a.ndim == 3 else 1, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *stored, tile_bytes(a, tile), difference_hash(a), None)

    def run(tables):
        for t in tables:
            at = t.schema.get_field_index("media")
            for begin in range(0, t.num_rows, 256):
                part = t.slice(begin, 256)
                rows = list(zip(*[one(x.as_py()) for x in part.column(at)], strict=True))
                made = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in keys] + made, [*keys, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [made])
    return media.select(*keys, "media").mapInArrow(tidy(run), schema)


def tile_hashes(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, feature and the SHA-256 of the NPY tiles (lowercase hex), as read from their table."""
    return tiles.select(*keys, "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a PGM or BMP in a media table, reads it back, writes the NPY tiles and difference hashes as a
    table, and returns the digests of what was read."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op1")
    stored = scratch.save(texts_to_media(docs), "media")
    made = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    tiles = scratch.save(features(stored, ["doc_id", "n_bytes"]).select(*made, "feature", "tile"), "tiles")
    return tile_hashes(tiles, made)
