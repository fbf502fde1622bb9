import math
import struct
import zlib

import numpy as np
import pytest

from textquarry.functions import images as I
from textquarry.sources import datagen as G
from textquarry.sources.files import read_images


def test_dct_against_its_formula():
    g = G.gray_image(5).reshape(32, 32).astype(float)
    got = I.dct8x8(g.reshape(1, -1))[0].reshape(8, 8)
    alpha = lambda j: math.sqrt((1 if j == 0 else 2) / 32)
    for j, k in ((0, 0), (0, 3), (5, 2), (7, 7)):
        expected = alpha(j) * alpha(k) * sum(g[y, x] * math.cos(math.pi * (2 * y + 1) * j / 64) * math.cos(math.pi * (2 * x + 1) * k / 64) for y in range(32) for x in range(32))
        assert abs(got[j, k] - expected) < 0.05


def test_phash_bits():
    coefficients = I.dct8x8(G.gray_image(9).reshape(1, -1))[0]
    middle = float(np.float32((np.sort(coefficients)[31] + np.sort(coefficients)[32]) / 2))
    bits = sum(1 << k for k, c in enumerate(coefficients) if c > middle)
    assert int(I.phash(G.gray_image(9).reshape(1, -1))[0]) % 2**64 == bits


@pytest.mark.parametrize(("radius", "total"), [(1, 4095), (2, 4095), (5, 4098), (8, 4095), (12, 4099), (16, 4099), (24, 4094), (30, 4100), (48, 4095), (64, 4085)])
def test_taps(radius, total):
    taps, reciprocal, shift = I.gaussian_taps(radius)
    assert (int(taps.sum()), reciprocal, shift) == (total, 16, 16)


def blurred(image, h, w, r):
    taps, reciprocal, shift = I.gaussian_taps(r)
    for dy, dx in ((0, 1), (1, 0)):
        out = np.zeros_like(image)
        for y in range(h):
            for x in range(w):
                for c in range(4):
                    s = sum(int(taps[k + r]) * int(image[min(h - 1, max(0, y + dy * k)), min(w - 1, max(0, x + dx * k)), c]) for k in range(-r, r + 1))
                    out[y, x, c] = min(255, s * reciprocal >> shift)
        image = out
    return image


def test_blur_twin():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (7, 9, 4))
    for r in (1, 3, 12):
        assert (I.blur(image.astype(np.uint8), 9, 7, r) == blurred(image, 7, 9, r)).all()
    assert (I.blur(image.astype(np.uint8), 9, 7, 0) == image).all()
    assert I.blur(np.full((4, 4, 4), 255, np.uint8), 4, 4, 1)[0, 0, 3] == 253  # 254 after the first pass
    assert [I.radius_of(x) for x in ("3.9", -2, 99, None, "x")] == [3, 0, 64, 0, 0]


def decoded(data, w, h):
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)
    assert (rows[:, 0] == 2).all()
    return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8)


def test_png_round_trip():
    rng = np.random.default_rng(2)
    for w, h, image in ((5, 3, rng.integers(0, 256, (3, 5, 4))), (40, 30, np.tile(np.arange(40) // 4, (30, 1))[:, :, None].repeat(4, 2)), (1, 1, np.zeros((1, 1, 4)))):
        image = image.astype(np.uint8)
        for fast in (False, True):
            assert (decoded(I.png(image, w, h, fast), w, h) == image.reshape(h, -1)).all()


def test_deflate_any_bytes():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"abcabcabcabc" * 50, bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), b"\0" * 70000, bytes(rng.integers(0, 3, 40000, dtype=np.uint8))):
        assert zlib.decompress(I.zlib_stream(data)) == data
    assert len(I.deflate_fixed(b"\0" * 70000)) < 700


def test_symbols_are_coded_once():
    assert len(I._SYMBOLS) == 288 and len({(c, n) for c, n in I._SYMBOLS}) == 288
    assert I._SYMBOLS[0] == (int("00001100", 2), 8) and I._SYMBOLS[256] == (0, 7) and I._SYMBOLS[285] == (int("10100011", 2), 8)


def test_sizes():
    assert I.fit_within(1800, 900) == (900, 450) and I.fit_within(100, 50) == (100, 50)
    flat = np.full((8, 6, 4), 77, np.uint8)
    assert (I.resize(flat, 6, 8, 32, 32) == 77).all()
    assert I.gray(np.array([255, 0, 0, 255]))[0] == np.float32(0.299 * 255)


def test_udfs_and_source(spark, tmp_path):
    rows = G.rgba_images(spark, 2, 16)
    r = rows.select("data", I.png_udf("data", "width", "height").alias("png"), I.blur_udf("data", "width", "height", I.F.lit(2)).alias("b")).first()
    assert bytes(r["b"]) == I.blur(np.frombuffer(r["data"], np.uint8), 16, 16, 2).tobytes()
    (tmp_path / "a.png").write_bytes(bytes(r["png"]))
    back = read_images(spark, str(tmp_path)).first()
    assert (back["width"], back["height"], bytes(back["data"])) == (16, 16, bytes(r["data"]))
    gray = read_images(spark, str(tmp_path)).select(I.phash_udf(I.gray32_udf("data", "width", "height")).alias("h")).first()
    assert isinstance(gray["h"], int)


def test_planted_copies_are_found(spark):
    """In the seeded library every copy is within 8 bits; the query counts the same in the pictures of the pages."""
    from pyspark.sql import functions as F

    from textquarry.operators.simhash import hamming
    from textquarry.plans.registry import planted_recall
    from textquarry.sources import datagen

    def counted(rows):
        prints = rows.select("img_id", "source", I.phash_udf("gray").alias("h")).toPandas().set_index("img_id")
        pairs = [(h, prints["h"][int(s)]) for s, h in zip(prints["source"], prints["h"], strict=True) if s == s and s is not None]
        return len(pairs), sum(((int(a) ^ int(b)) % (1 << 64)).bit_count() <= 8 for a, b in pairs)

    assert counted(datagen.gray_library(spark, 500)) == (5, 5)
    folder = "/root/testdata/sf0.001"
    row = planted_recall(spark, folder).first()
    assert (row["n"], row["found"]) == counted(datagen.page_grays(spark.read.parquet(f"{folder}/pages.parquet")))
    assert spark.range(1).select(hamming(F.lit(5), F.lit(6))).first()[0] == 2
