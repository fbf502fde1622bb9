"""Sets of word shingles as sorted 64-bit hashes, computed with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: A-Z become a-z; everything else stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything once it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; with fewer words, of the whole sequence.

    Words are separated by the ASCII blanks 0x20 and 0x09-0x0D, as bytes.split() has them. 64-bit
    hashes stand for shingles: two different ones among n meet with a chance of n * n / 2**65.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * _ROUND + w[k : k + n])
    return np.unique(out)


def set_key(features: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)
