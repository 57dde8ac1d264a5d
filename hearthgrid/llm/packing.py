"""Integer columns packed into compressed byte planes, for rows that carry many entries at once."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """int64 columns of one length; equal or slowly changing values cost next to nothing."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(np.asarray(c, dtype="<i8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns]
    return zstandard.compress(len(columns).to_bytes(4, "little") + b"".join(planes), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count = int.from_bytes(raw[:4], "little")
    n = (len(raw) - 4) // (8 * count)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=4).reshape(count, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences to the value before, the first to zero."""
    return np.diff(values, prepend=np.zeros(1, dtype=values.dtype))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Positions where a run of equal tuples starts."""
    n = len(columns[0])
    if not n:
        return np.empty(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]
