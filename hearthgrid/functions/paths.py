"""Order of the parts of small groups of lines: many groups at a time, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..session import ship_active
from . import geometry as G

# numbers in one table of distances
_TABLE = 1_000_000


def _places(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """The first of the ends that steps of at most ``tol`` connect, for groups (rows) of equally many ends."""
    dx, dy = x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]
    near = np.sqrt(dx * dx + dy * dy) <= tol
    place = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    while True:
        least = np.where(near, place[:, None, :], x.shape[1]).min(axis=2)
        if (least == place).all():
            return place
        place = least


def _ranks(ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tail, steps to it, least part on the way and whether there is no tail, of states with the next one (-1 at the end)."""
    own = np.broadcast_to(np.arange(ahead.shape[1]), ahead.shape)
    tail, rank, low = np.where(ahead < 0, own, ahead), (ahead >= 0).astype(np.int64), own // 2
    for _ in range(max(1, int(ahead.shape[1] - 1).bit_length())):
        rank = rank + np.take_along_axis(rank, tail, 1)
        low = np.minimum(low, np.take_along_axis(low, tail, 1))
        tail = np.take_along_axis(tail, tail, 1)
    return tail, rank, low, np.take_along_axis(ahead, tail, 1) >= 0


def longest_paths(ends: np.ndarray, lengths: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """For groups of m parts (``ends``: groups x m x 4, ``lengths``: groups x m): the steps 2 * part + reversed of the longest
    line, first ones first, and how many they are.

    Parts join at places where exactly two ends of different parts meet. A line starts at the end whose
    part comes first, a ring with its first part; of equally long lines the one with the first part counts.
    """
    groups, m = lengths.shape
    own = np.arange(2 * m)
    place = _places(ends[:, :, 0::2].reshape(groups, -1), ends[:, :, 1::2].reshape(groups, -1), tol)
    same = place[:, :, None] == place[:, None, :]
    same[:, own, own] = False
    mate = same.argmax(axis=2)
    mate = np.where((same.sum(axis=2) == 1) & (mate // 2 != own // 2), mate, -1)
    # a state is a part in one direction (0 as it is, 1 reversed); it leaves at side 1 - direction
    ahead = mate[:, own ^ 1]
    tail, rank, low, ring = _ranks(ahead)
    if ring.any():
        # a ring is cut in front of its first part, and the way back in front of the same place
        tail, rank, _, _ = _ranks(np.where(ring & ((ahead == 2 * low) | (own == 2 * low + 1)), -1, ahead))
    first, last = tail[:, 1::2] // 2, tail[:, 0::2] // 2
    turned, chain = first > last, np.minimum(first, last)
    members = chain[:, :, None] == np.arange(m)
    total = np.where(members.any(axis=1), (lengths[:, :, None] * members).sum(axis=1), -1.0)
    chosen = chain == total.argmax(axis=1)[:, None]
    pos = np.where(chosen, np.where(turned, rank[:, 0::2], rank[:, 1::2]), m)
    order = pos.argsort(axis=1, kind="stable")
    return 2 * order + np.take_along_axis(turned, order, 1), chosen.sum(axis=1)


def longest_path(lines: str, tol: float) -> Column:
    """array<int> of the steps 2 * part + reversed of the longest line that the parts ``lines`` (array<line>, few, of known length) join to."""
    ship_active()

    @F.arrow_udf("array<int>")
    def steps(parts: pa.Array) -> pa.Array:
        counts = np.diff(parts.offsets.to_numpy())
        flat = parts.flatten()
        ends = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")])
        lengths = flat.field("len").to_numpy(zero_copy_only=False)
        start = np.cumsum(counts) - counts
        found = []
        for m in np.unique(counts[counts > 0]).tolist():
            rows = np.flatnonzero(counts == m)
            for at in np.array_split(rows, -(-len(rows) * 4 * m * m // _TABLE)):
                inside = start[at][:, None] + np.arange(m)
                found.append((at, *longest_paths(ends[inside], lengths[inside], tol)))
        sizes = np.zeros(len(counts), dtype=np.int64)
        for at, _, n in found:
            sizes[at] = n
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        values = np.empty(offsets[-1], dtype=np.int32)
        for at, order, n in found:
            used = np.arange(order.shape[1]) < n[:, None]
            values[(offsets[at][:, None] + np.arange(order.shape[1]))[used]] = order[used]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    return steps(F.transform(lines, lambda l: F.struct(
        *[p[c].alias(f"{e}{c}") for e, p in (("a", G.start_point(l)), ("b", G.end_point(l))) for c in "xy"], G.length(l).alias("len"))))
