"""Image codecs, resizing and the media query against plain computations."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from tesserae.llm import media


def test_netpbm_forms():
    grey = np.array([[0, 128, 255], [7, 8, 9]], np.uint8)
    assert (media.decode(b"P2 # comment\n3 2\n255\n0 128 255 7 8 9") == grey).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P5\n3 2\n65535\n" + grey.astype(">u2").tobytes()) == grey).all()
    bits = np.array([[1, 0, 1], [0, 1, 0]])
    for data in (b"P1\n3 2\n101\n010", b"P4\n3 2\n" + np.packbits(bits, axis=1).tobytes()):
        assert (media.decode(data) == (1 - bits) * 255).all()
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6 3 2 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3 3 2 255\n" + b" ".join(b"%d" % x for x in rgb.ravel())) == rgb).all()


def test_bmp_round_trips():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 4), (3, 5, 3)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_bmp(a)) == a).all()


@pytest.mark.parametrize("data", [b"", b"P9 1 1 255\n0", b"BM", b"P5\n4 4\n255\nxx", b"P5\n0 4\n255\n", b"text"])
def test_unreadable_images_raise(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_resize_is_the_mean_over_areas():
    a = np.random.default_rng(2).integers(0, 256, (6, 10)).astype(np.float64)
    big = np.kron(a, np.ones((16, 16)))  # every fraction of a sixteenth is a whole pixel
    for h, w in ((1, 1), (3, 5), (8, 16), (4, 2)):
        want = big.reshape(h, 96 // h, w, 160 // w).mean(axis=(1, 3))
        assert np.allclose(media.resize(a, h, w), want)


def shares(n, m):
    """Overlaps of n pixels with m equal stretches, as parts of a stretch."""
    at = np.arange(m + 1) * n / m
    low, high = np.maximum(at[:-1, None], np.arange(n)), np.minimum(at[1:, None], np.arange(n) + 1)
    return np.maximum(0, high - low) * m / n


def test_tiles_and_hashes_by_overlaps():
    rng = np.random.default_rng(6)
    for h in (1, 3, 17, 40):
        a = rng.integers(0, 256, (h, 64)).astype(np.uint8)
        tile = np.load(io.BytesIO(media.tile_bytes(a)))
        assert tile.dtype == np.uint8 and (np.abs(tile - shares(h, 16) @ a @ shares(64, 16).T) <= 0.5 + 1e-9).all()
        small = shares(h, 8) @ a @ shares(64, 9).T
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.difference_hash(a)), np.uint8)).reshape(8, 8).astype(bool)
        rise = small[:, 1:] - small[:, :-1]
        assert (bits == (rise > 0))[np.abs(rise) > 0.01].all()


def test_query_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in media.op1_media_columns(spark, sf_dir).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        full = raw + b"\0" * (-len(raw) % 64)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        pixels = np.frombuffer(full, np.uint8).reshape(-1, 64)
        stored = media.encode_bmp(pixels) if zlib.crc32(raw) % 2 else b"P5\n64 %d\n255\n" % len(pixels) + full
        assert g.tile_sha256 == hashlib.sha256(media.tile_bytes(pixels)).hexdigest()
        assert (g.tail_crc32, g.media_bytes, g.media_sha256) == (zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert len(g.feature) == 16


def test_awkward_rows_and_tiles(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (2, "", None), (3, "é" * 32, None), (4, "y" * 3_000_000, None), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    for form in ("pgm", "bmp"):
        out = media.features(media.texts_to_media(docs, form), ["doc_id", "n_bytes"]).collect()
        assert sorted(r.payload_bytes for r in out) == [64, 64, 64, 64, 64, 3_000_000]
        assert all(np.load(io.BytesIO(r.tile)).shape == (16, 16) for r in out)
        assert len({r.feature for r in out if r.doc_id == 2}) == 1
    broken = media.features(spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary"), ["doc_id"]).orderBy("doc_id").collect()
    assert [bool(r.error) for r in broken] == [True, True] and broken[0].media_bytes == 4 and broken[1].payload_sha256 is None
    assert media.features(media.texts_to_media(docs.limit(0)), ["doc_id"]).count() == 0
