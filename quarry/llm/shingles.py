"""Word shingles as 64-bit fingerprints, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes); bounded, so that it may live as long as a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z: runs of anything but blank and \\t \\n \\v \\f \\r."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles; a text of fewer words has its whole sequence as one."""
    found = words(text)
    n = len(found)
    if not n:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(known.__getitem__, found), "uint64", n)
    size = min(width, n)
    out = np.full(n - size + 1, n if n < width else 0, "uint64")
    for k in range(size):
        out = mix(out * _BASE + h[k : n - size + 1 + k])
    return np.unique(out)


def salts(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends (32 bits) of the minhash functions, fixed by their number."""
    drawn = mix(np.arange(1, 2 * count + 1, dtype="uint64") * _BASE).astype("uint32")
    return drawn[:count] | np.uint32(1), drawn[count:]


def minhashes(fingerprints: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value under each function x -> x * multiplier + addend of 32 bits."""
    multipliers, addends = functions
    x = (fingerprints >> np.uint64(32)).astype("uint32")
    out = np.empty(len(multipliers), "uint64")
    step = max(1, 65_536 // max(1, len(x)))  # so that the products stay in the processor's cache
    for k in range(0, len(multipliers), step):
        out[k : k + step] = (x[None, :] * multipliers[k : k + step, None] + addends[k : k + step, None]).min(axis=1)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
