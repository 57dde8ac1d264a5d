"""Compression of vectors to short codes: one codebook per part of the vector, in whole numbers.

Tasks pack their vectors once into flat blocks: per part, in the order of the Hilbert curve, with the box
(least and greatest components) and the sum of every block. A round sends the codebooks to the
packed blocks. The distances from a box to the entries leave a short list of entries that can be the
nearest one for some member; a block with one entry left adds its stored sum, the others are
compared with their list in whole numbers. Tasks return sums per entry, so a round shuffles a
fixed number of rows per task, whatever the vectors look like. Nothing is rounded, so the
results do not depend on how the rows are spread.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import in_arrow, query, store, table

PARTS, ENTRIES, ROUNDS, SCALE, CHUNK, BLOCK, SLAB, FEW_LABELS = 16, 64, 2, 256, 8192, 32, 200_000, 10_000
#: distances and indexes share 64 bits
_MOST = 2**63


class Codebooks(NamedTuple):
    """entries: whole numbers by (part, entry, position); size: components of a vector before it is filled up."""
    entries: np.ndarray
    size: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Positions of the rows of ``points`` (whole numbers) along a Hilbert curve, by Skilling's transposition."""
    n, dims = points.shape
    x = (points - points.min(axis=0)).astype(np.uint64).T[:62].copy()
    bits = max(1, min(62 // len(x), int(x.max(initial=0)).bit_length()))
    x >>= np.uint64(max(0, int(x.max(initial=0)).bit_length() - bits))
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(len(x)):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint64(b)) & one == one, turn ^ ((one << np.uint64(b)) - one), turn)
    x ^= turn
    key = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return np.argsort(key, kind="stable")


def pack_part(points: np.ndarray) -> dict[str, bytes]:
    """Blocks of the distinct points of one part: points, how often each occurs, whose they are, boxes and sums."""
    order = hilbert_order(points)
    sorted_ = points[order]
    new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)]  # equal points are neighbours on the curve unless bits were cut
    start = np.nonzero(new)[0]
    distinct, count = sorted_[start], np.diff(np.r_[start, len(order)])
    own = np.empty(len(order), dtype=np.int32)
    own[order] = np.cumsum(new) - 1
    edge = np.arange(0, len(distinct), BLOCK)
    boxes = np.stack([np.minimum.reduceat(distinct, edge), np.maximum.reduceat(distinct, edge), np.add.reduceat(distinct * count[:, None], edge)])
    return {"points": distinct.astype("<i4").tobytes(), "counts": count.astype("<i4").tobytes(), "own": own.tobytes(), "boxes": boxes.astype("<i8").tobytes()}


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, and the entry of each block that has only one choice (else -1)."""
    k = len(entries)
    gap = np.maximum(np.maximum(low[:, None] - entries[None], entries[None] - high[:, None]), 0)
    far = np.maximum(np.abs(entries[None] - low[:, None]), np.abs(entries[None] - high[:, None]))
    listed = (gap * gap).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1, keepdims=True)
    block, entry = np.nonzero(listed)
    size = np.bincount(block, minlength=len(low))
    first = np.r_[0, np.cumsum(size)]
    only = np.where(size == 1, entry[first[:-1]], -1)
    best = np.empty(len(points), dtype=np.int64)
    a = 0
    while a < len(low):  # slabs of blocks, so that the distances of a slab stay small
        b = max(a + 1, int(np.searchsorted(first, first[a] + max(1, SLAB // BLOCK), side="right")) - 1)
        b = min(b, len(low))
        mine, e = block[first[a]:first[b]], entry[first[a]:first[b]]
        at = np.minimum(mine[:, None] * BLOCK + np.arange(BLOCK), len(points) - 1)
        d = points[at] - entries[e][:, None]
        keyed = (d * d).sum(axis=2) * k + e[:, None]  # the lower index wins a tie
        least = np.minimum.reduceat(keyed, first[a:b] - first[a], axis=0).ravel()
        upto = min(b * BLOCK, len(points))
        best[a * BLOCK:upto] = least[:upto - a * BLOCK]
        a = b
    return best % k, best // k, only


class VectorCodes:
    """Vectors packed into blocks, with what is needed to fit codebooks and to encode.

    Rows whose vector is null or holds null or non-finite components are left out. Components become
    floor(scale x component). Vectors are filled up with zeros at the end to the length of the longest one,
    and that to a multiple of ``parts``; an empty vector is all zeros. Components beyond what 64-bit
    distances can hold (2^24 for 16 parts of 4 and 64 entries) raise an ArithmeticError. Ids may repeat or be null
    (last in order); rows of one id are ordered by their vectors. Extra columns are not read.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                 parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, chunk: int = CHUNK):
        label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
        v = F.col(vector_col).cast("array<double>")
        fit = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        kept = vectors.filter(fit).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"))
        self.scale, self.parts, self.label_type = scale, parts, kept.schema["label"].dataType.simpleString()
        self.size = int(kept.agg(F.max(F.size("v"))).first()[0] or 0)
        self.width = width = max(1, -(-self.size // parts))
        full, bound = width * parts, int((_MOST / (width * max(1, entries))) ** 0.5 / 2) - 1

        def whole(rows: list) -> np.ndarray:
            x = np.zeros((len(rows), full))
            for k, r in enumerate(rows):
                x[k, :len(r)] = r
            x = np.floor(x * scale)
            if np.abs(x).max(initial=0) > min(bound, 2**30):
                raise ArithmeticError(f"components beyond {bound / scale:g} do not fit 64-bit distances")
            return x.astype(np.int64)

        def packed(ids: list, labels: list, rows: list) -> dict:
            x = whole(rows).reshape(len(rows), parts, width)
            return {"ids": [ids], "labels": [labels], "blocks": [[pack_part(np.ascontiguousarray(x[:, p])) for p in range(parts)]]}

        def run(batches):
            ids, labels, rows = [], [], []
            for b in batches:
                ids, labels, rows = ids + b["id"], labels + b["label"], rows + b["v"]
                while len(rows) >= chunk:
                    yield packed(ids[:chunk], labels[:chunk], rows[:chunk])
                    ids, labels, rows = ids[chunk:], labels[chunk:], rows[chunk:]
            if rows:
                yield packed(ids, labels, rows)

        schema = f"ids array<long>, labels array<{self.label_type}>, blocks array<struct<points:binary,counts:binary,own:binary,boxes:binary>>"
        self.blocks = store(in_arrow(kept, run, schema), "vector-blocks")
        # a fixed number of rows: they are the first codebooks
        first = kept.orderBy(F.col("id").isNull(), "id", "v").limit(entries).select("v").collect()
        start = whole([r["v"] for r in first]).reshape(len(first), parts, width)
        self.codebooks = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), self.size)

    @staticmethod
    def _part(block: dict, width: int):
        points = np.frombuffer(block["points"], dtype="<i4").reshape(-1, width).astype(np.int64)
        boxes = np.frombuffer(block["boxes"], dtype="<i8").reshape(3, -1, width)
        return points, np.frombuffer(block["counts"], dtype="<i4"), np.frombuffer(block["own"], dtype="<i4"), boxes

    def refine(self) -> None:
        """One round: every part goes to its nearest entry, entries become the floor of the mean of their parts."""
        books, width, part_of = self.codebooks.entries, self.width, self._part
        parts, k = books.shape[:2]
        if not k:
            return

        def run(batches):
            total = np.zeros((parts, k, width + 1), dtype=np.int64)
            for b in batches:
                for blocks in b["blocks"]:
                    for p, block in enumerate(blocks):
                        points, count, _, (low, high, sums) = part_of(block, width)
                        entry, _, only = nearest(points, low, high, books[p])
                        whole = only >= 0
                        np.add.at(total[p, :, 1:], only[whole], sums[whole])
                        single = ~np.repeat(whole, BLOCK)[:len(points)]
                        np.add.at(total[p, :, 1:], entry[single], points[single] * count[single, None])
                        total[p, :, 0] += np.bincount(entry, count, k).astype(np.int64)
            some = np.nonzero(total[:, :, 0].ravel())[0]
            yield {"cell": some, "sums": list(total.reshape(parts * k, width + 1)[some])}

        sums = in_arrow(self.blocks.select("blocks"), run, "cell int, sums array<long>")
        # parts x entries rows come back
        merged = sums.groupBy("cell").agg(F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(width + 1)]).alias("sums")).collect()
        new = books.reshape(parts * k, width).copy()
        for r in merged:
            n, *s = map(int, r["sums"])
            new[r["cell"]] = [v // n for v in s]
        self.codebooks = Codebooks(new.reshape(books.shape), self.size)

    def encode(self) -> DataFrame:
        """Columns id, label, codes (entry numbers in the order of the parts), error (squared distances summed)."""
        books, width, part_of = self.codebooks.entries, self.width, self._part

        def run(batches):
            for b in batches:
                for ids, labels, blocks in zip(b["ids"], b["labels"], b["blocks"]):
                    codes, error = np.empty((len(ids), len(books)), dtype=np.int32), np.zeros(len(ids), dtype=np.int64)
                    for p, block in enumerate(blocks):
                        points, _, own, (low, high, _) = part_of(block, width)
                        entry, distance, _ = nearest(points, low, high, books[p])
                        codes[:, p] = entry[own]
                        error += distance[own]
                    yield {"id": ids, "label": labels, "codes": list(codes), "error": error}
        return in_arrow(self.blocks, run, f"id long, label {self.label_type}, codes array<int>, error long")


def fit_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
              parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors (see ``VectorCodes.encode``) and the codebooks they refer to.

    Codebooks start as the vectors of the smallest ids; a table of fewer rows has fewer entries, an
    empty one none, and then the result is empty. Entries that no part chooses stay as they are.
    """
    packed = VectorCodes(vectors, id_col, vector_col, label_col, parts, entries, scale)
    for _ in range(rounds):
        packed.refine()
    return packed.encode(), packed.codebooks


def decode_codes(codes: DataFrame, books: Codebooks, codes_col: str = "codes", scale: int = SCALE) -> DataFrame:
    """``codes`` with a column vector: the entries that the codes name, divided by ``scale``."""
    ship_package(codes.sparkSession)
    names = codes.columns + ["vector"]

    def run(batches):
        for b in batches:
            at = np.array(b.column(codes_col).to_pylist(), dtype=np.int64).reshape(b.num_rows, len(books.entries))
            out = books.entries[np.arange(at.shape[1]), at].reshape(b.num_rows, -1)[:, :books.size] / scale
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), type=pa.list_(pa.float64()))], names=names)
    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", vector array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the error summed over equal labels, nulls together.

    Sums of few labels are broadcast; more meet their rows in a shuffle join of which adaptive execution
    splits large partitions.
    """
    sums = store(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["of"])).drop("of")


@query("op13_vector_codes")
def op13(spark, sf_dir):
    coded, books = fit_codes(table(spark, sf_dir, "embeddings"))
    rows = label_errors(store(coded, "codes"))
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
