"""Kernels over pixel arrays in numpy: luma, DCT, perceptual hash, blur, PNG. Wrapped as Arrow UDFs below."""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType

SIDE = 32
#: Hash chain bits, window, longest and shortest match and chain limit of the compressor.
HASH_BITS, WINDOW, LONGEST, SHORTEST, CHAIN = 15, 32768, 258, 3, 128
#: Fixed values of RFC 1951: base and extra bits of length codes 257-285 and distance codes 0-29.
LENGTH_BASE = (3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258)
LENGTH_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0)
DISTANCE_BASE = (1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577)
DISTANCE_EXTRA = (0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13)


def gray(rgba: np.ndarray) -> np.ndarray:
    """Luma of RGBA bytes as 32-bit numbers."""
    p = np.asarray(rgba, np.uint8).reshape(-1, 4).astype(np.float64)
    return (0.299 * p[:, 0] + 0.587 * p[:, 1] + 0.114 * p[:, 2]).astype(np.float32)


def resize(rgba: np.ndarray, width: int, height: int, to_width: int, to_height: int) -> np.ndarray:
    """Stretch by area averaging; browsers differ here, so only what follows from the gray array is comparable."""
    image = np.asarray(rgba, np.uint8).reshape(height, width, 4).astype(np.float64)

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(n) + 1)
        w = np.clip(high - low, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    out = np.einsum("yh,hwc,xw->yxc", weights(height, to_height), image, weights(width, to_width))
    return np.floor(out + 0.5).astype(np.uint8)


def fit_within(width: int, height: int, longest: int = 900) -> tuple[int, int]:
    """The size with the long edge at most `longest`, never enlarged."""
    scale = min(1.0, longest / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


@functools.lru_cache(maxsize=1)
def dct_table() -> np.ndarray:
    """Row j: alpha(j) * cos(pi * (2i + 1) * j / 64)."""
    i, j = np.arange(SIDE), np.arange(SIDE)[:, None]
    alpha = np.where(j == 0, math.sqrt(1 / SIDE), math.sqrt(2 / SIDE))
    return (alpha * np.cos(np.pi * (2 * i + 1) * j / (2 * SIDE))).astype(np.float32)


def dct8x8(grays: np.ndarray) -> np.ndarray:
    """The 8 by 8 lowest frequencies of gray images of 32 by 32: rows of 1024 -> rows of 64."""
    c = dct_table()[:8].astype(np.float64)
    return np.einsum("jy,nyx,kx->njk", c, np.asarray(grays, np.float64).reshape(-1, SIDE, SIDE), c, optimize=True).reshape(-1, 64).astype(np.float32)


def phash(grays: np.ndarray) -> np.ndarray:
    """Bit i is set where coefficient i exceeds the median of all 64."""
    coefficients = dct8x8(grays)
    middle = np.sort(coefficients, axis=1)[:, 31:33].mean(axis=1, keepdims=True, dtype=np.float32)
    return np.packbits(coefficients > middle, axis=1, bitorder="little").view("<i8").ravel()


def gaussian_taps(radius: int) -> tuple[np.ndarray, int, int]:
    """Integer weights of about 4096 together, and the reciprocal and shift that divide by them."""
    sigma = max(radius / 2, 0.5)
    raw = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    taps = np.floor(raw / raw.sum() * 4096 + 0.5).astype(np.int64)
    return taps, int(math.floor(65536 / taps.sum() + 0.5)), 16


def radius_of(value) -> int:
    """Truncated and held between 0 and 64."""
    try:
        return max(0, min(64, int(float(value))))
    except (TypeError, ValueError, OverflowError):
        return 0


def blur(rgba: np.ndarray, width: int, height: int, radius: int) -> np.ndarray:
    """Separable Gaussian in integers, edges clamped; each pass rounds down and clamps by itself."""
    image = np.asarray(rgba, np.uint8).reshape(height, width, 4).astype(np.int64)
    radius = radius_of(radius)
    if not radius:
        return image.astype(np.uint8)
    taps, reciprocal, shift = gaussian_taps(radius)
    for axis in (1, 0):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        wide, n = np.pad(image, pad, mode="edge"), image.shape[axis]
        total = sum(t * np.take(wide, range(k, k + n), axis=axis) for k, t in enumerate(taps.tolist()))
        image = np.clip(total * reciprocal >> shift, 0, 255)
    return image.astype(np.uint8)


# ---- PNG --------------------------------------------------------------------------------------------


def filter_up(rgba: np.ndarray, width: int, height: int) -> bytes:
    """Each row less the row above it, behind the filter's number 2."""
    rows = np.asarray(rgba, np.uint8).reshape(height, width * 4)
    above = np.vstack([np.zeros((1, width * 4), np.uint8), rows[:-1]])
    return np.hstack([np.full((height, 1), 2, np.uint8), rows - above]).tobytes()


def _fixed(s: int) -> tuple[int, int]:
    """The fixed code of a literal or length, its highest bit first, and its bits."""
    code, n = (48 + s, 8) if s < 144 else (400 + s - 144, 9) if s < 256 else (s - 256, 7) if s < 280 else (192 + s - 280, 8)
    return int(format(code, f"0{n}b")[::-1], 2), n


#: Built once: every symbol's code as it is put.
_SYMBOLS = [_fixed(s) for s in range(288)]


class _Bits:
    """Bits from the lowest up."""

    def __init__(self):
        self.value, self.count, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n
        while self.count >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.count -= 8

    def code(self, code: int, n: int) -> None:
        """Huffman codes go from the highest bit down."""
        self.put(int(format(code, f"0{n}b")[::-1], 2), n)

    def symbol(self, s: int) -> None:
        self.put(*_SYMBOLS[s])

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 255]) if self.count else b"")


def _code(value: int, bases: tuple[int, ...]) -> int:
    import bisect

    return bisect.bisect_right(bases, value) - 1


def deflate_fixed(data: bytes) -> bytes:
    """One block of fixed codes; greedy matches through hash chains, the nearest of the longest wins."""
    bits, n = _Bits(), len(data)
    bits.put(1, 1)
    bits.put(1, 2)
    chains: dict[int, list[int]] = {}
    key = lambda i: (data[i] << 10 ^ data[i + 1] << 5 ^ data[i + 2]) & (1 << HASH_BITS) - 1
    at = 0
    while at < n:
        length, distance = 0, 0
        if at + SHORTEST <= n:
            for k, before in enumerate(reversed(chains.get(key(at), ()))):
                if k >= CHAIN or at - before > WINDOW:
                    break
                most, same = min(LONGEST, n - at), 0
                # only a longer match counts, and length is under most here
                if data[before + length] != data[at + length]:
                    continue
                while same < most and data[before + same] == data[at + same]:
                    same += 1
                if same > length:
                    length, distance = same, at - before
                    if same == most:
                        break
        if length < SHORTEST:
            bits.symbol(data[at])
            length = 1
        else:
            c = _code(length, LENGTH_BASE)
            bits.symbol(257 + c)
            bits.put(length - LENGTH_BASE[c], LENGTH_EXTRA[c])
            d = _code(distance, DISTANCE_BASE)
            bits.code(d, 5)
            bits.put(distance - DISTANCE_BASE[d], DISTANCE_EXTRA[d])
        for i in range(at, min(at + length, n - SHORTEST + 1)):
            chain = chains.setdefault(key(i), [])
            chain.append(i)
            if len(chain) > 4 * CHAIN:
                del chain[: 2 * CHAIN]
        at += length
    bits.symbol(256)
    return bits.done()


def zlib_stream(data: bytes) -> bytes:
    return b"\x78\x01" + deflate_fixed(data) + struct.pack(">I", zlib.adler32(data))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(rgba: np.ndarray, width: int, height: int, fast: bool = False) -> bytes:
    """8-bit RGBA. fast: compress with zlib, which is valid too but differs in its bytes."""
    raw = filter_up(rgba, width, height)
    body = zlib.compress(raw) if fast else zlib_stream(raw)
    header = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


# ---- Arrow UDFs -------------------------------------------------------------------------------------


def _rows(values: pd.Series, n: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float32)[:n] for v in values], np.float32).reshape(-1, n)


@F.pandas_udf(ArrayType(FloatType()))
def dct_udf(grays: pd.Series) -> pd.Series:
    return pd.Series(list(dct8x8(_rows(grays, SIDE * SIDE))))


@F.pandas_udf(LongType())
def phash_udf(grays: pd.Series) -> pd.Series:
    return pd.Series(phash(_rows(grays, SIDE * SIDE)))


@F.pandas_udf(ArrayType(FloatType()))
def gray32_udf(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([gray(resize(np.frombuffer(d, np.uint8), w, h, SIDE, SIDE)) for d, w, h in zip(data, width, height, strict=True)])


@F.pandas_udf(BinaryType())
def blur_udf(data: pd.Series, width: pd.Series, height: pd.Series, radius: pd.Series) -> pd.Series:
    return pd.Series([blur(np.frombuffer(d, np.uint8), w, h, r).tobytes() for d, w, h, r in zip(data, width, height, radius, strict=True)])


@F.pandas_udf(BinaryType())
def png_udf(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([png(np.frombuffer(d, np.uint8), w, h) for d, w, h in zip(data, width, height, strict=True)])
