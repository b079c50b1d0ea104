"""Images, language, licences, shards and URLs: formats, edge cases, plain versions."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import media

PIXELS = np.random.default_rng(3).integers(0, 256, (9, 13, 3), dtype=np.uint8)
GREY = PIXELS[:, :, 0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (media.encode_pgm(GREY), GREY),
        (media.encode_bmp(GREY), GREY),
        (media.encode_bmp(PIXELS), PIXELS),
        (b"P6 # a comment\n13 9\n255\n" + PIXELS.tobytes(), PIXELS),
        (b"P2\n2 2 # size\n15\n0 15\n5 10", np.array([[0, 255], [85, 170]])),
        (b"P3 1 1 255 1 2 3", np.array([[[1, 2, 3]]])),
        (b"P1\n3 1\n010", np.array([[255, 0, 255]])),
        (b"P4\n3 1\n\x40", np.array([[255, 0, 255]])),
        (b"P5 1 1 65535\n\xff\xff", np.array([[255]])),
    ],
)
def test_formats(raw, want):
    assert (media.decode(raw) == want).all()


def test_bmp_of_one_bit_and_from_the_top():
    info = struct.pack("<IiiHHIIiiII", 40, 3, -2, 1, 1, 0, 0, 0, 0, 2, 0)
    raw = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + info + bytes([0, 0, 0, 0, 255, 255, 255, 0]) + b"\xa0\0\0\0" + b"\x40\0\0\0"
    assert media.decode(raw)[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]


@pytest.mark.parametrize("raw", [b"", b"P5", b"P5 2 2 255\nx", b"GIF89a", b"BM" + bytes(10), media.encode_bmp(GREY)[:-5], b"P2 2 1 255 7"])
def test_broken_images_are_refused(raw):
    with pytest.raises((media.BadImage, struct.error)):
        media.decode(raw)


@settings(max_examples=60)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 9), st.integers(1, 9))
def test_area_resize_keeps_the_mean_of_each_area(h, w, height, width):
    image = np.random.default_rng(h * w).integers(0, 256, (h, w))
    fine = np.repeat(np.repeat(image, height, axis=0), width, axis=1)
    want = fine.reshape(height, h, width, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, height, width), want)


def test_difference_hash_and_tiles():
    ramp = np.tile(np.arange(90), (8, 1)).astype(np.uint8)
    assert media.difference_hash(ramp) == 2**64 - 1 and media.difference_hash(ramp[:, ::-1]) == 0
    assert np.load(io.BytesIO(media.thumbnail(ramp))).shape == (64, 64)


TEXTS = [(1, "abc"), (2, ""), (3, None), (4, "é" * 32), (5, "x" * 64), (6, "y" * 300_001), (1, "abc"), (None, "n")]


def plain_resize(image, height, width):
    """Each new sample as a weighted mean over the samples that it covers, one by one."""
    h, w = len(image), len(image[0])
    out = np.zeros((height, width))
    share = lambda k, n, of: [(i, min(i + 1, (k + 1) * of / n) - max(i, k * of / n)) for i in range(of) if min(i + 1, (k + 1) * of / n) > max(i, k * of / n)]
    for y in range(height):
        for x in range(width):
            out[y, x] = sum(image[i][j] * a * b for i, a in share(y, height, h) for j, b in share(x, width, w)) * height * width / h / w
    return out


def test_feature_and_tile_against_a_plain_version(spark):
    texts = [(1, "The quick brown fox. " * 20), (2, "ab" * 100), (3, "é" * 61), (4, "line of text " * 340)]
    for r in media.text_media(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        raw = dict(texts)[r["doc_id"]].encode()
        image = [list((raw + bytes(-len(raw) % 64))[i : i + 64]) for i in range(0, len(raw), 64)]
        small = plain_resize(image, 8, 9)
        bits = "".join("01"[int(small[y, x + 1] > small[y, x] + 1e-9)] for y in range(8) for x in range(8))
        assert r["feature"] == f"{int(bits, 2):016x}"
        tile = np.load(io.BytesIO(r["tile"]))
        height = min(64, len(image))
        assert tile.dtype == np.uint8 and tile.shape == (height, 64) and np.abs(tile - plain_resize(image, height, 64)).max() <= 0.5 + 1e-6


def test_texts_as_images(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, MEDIA string")
    got = media.text_media(df).collect()
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((str(i), len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    same = [tuple(r) for r in got if r["doc_id"] == 1]
    assert same[0] == same[1] and all(len(r["feature"]) == 16 for r in got)


def test_features_of_a_column(spark):
    rows = [(1, media.encode_bmp(PIXELS)), (2, None), (3, b"nonsense"), (4, media.encode_pgm(GREY)), (None, b"")]
    got = {r["id"]: r for r in media.features(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert (got[1]["height"], got[1]["width"]) == (9, 13) and got[1]["error"] is None
    assert all(got[k]["error"] and got[k]["dhash"] is None for k in (2, 3, None))
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
