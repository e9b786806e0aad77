"""Words of texts as bytes, and integers packed for storage."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and turns every byte that is no part of a word into a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_bytes(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z: runs of digits, a-z and anything beyond ASCII."""
    return text.translate(_WORDS).split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers of 32 bits as differences, byte by byte in planes, so that rising runs compress well."""
    steps = np.diff(values.astype("<u4"), prepend=np.uint32(0)).astype("<u4")  # falls wrap around
    return steps.view("u1").reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """What `pack` was given."""
    planes = np.frombuffer(data, "u1").reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype="uint32")
