"""Shared pieces of the corpus operators: Arrow batches, word splitting, tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, ship_package

UNPACKED_BYTES, BUCKET_BYTES = 4_000_000, 8_000_000
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the driver tables."""
    def register(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark) -> None:
    """Send the package to the executors, and let tasks hand texts to Python a few MB at a time.

    Spark's own bound for a batch is 64 MB, which a worker holds several times over.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(UNPACKED_BYTES))


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: the plan below is done once and survives lost executors.

    Once written, nothing reads the shuffles of this plan again, so their files go at once.
    """
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns id, text (and ``more``): the whole text as UTF-8 bytes, null as the empty text.

    Only these are read, so extra columns of any name do no harm.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("text"), *more)


def text_bytes(texts: DataFrame) -> int:
    """Bytes of all texts (column text)."""
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(spark, size: int) -> int:
    """Buckets of hashes for ``size`` bytes of text: one bucket stays as small however large the corpus is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * UNPACKED_BYTES // max(batch.nbytes, UNPACKED_BYTES))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def give_back() -> None:
    """Hand free memory back to the system at the end of a task: workers live on and serve other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over column dicts: lists of Python values or numpy arrays in, the same out.

    Batches of long texts are unpacked a few MB at a time.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        def read():
            for b in batches:
                for part in slices(b):
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
        for out in fn(read()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, wanted: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Rows of which the whole text (null: empty) is wanted; all columns pass through untouched."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                texts = [(t or "").encode() for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                yield b.filter(pa.array(np.asarray(wanted(texts), dtype=bool)))
        give_back()
    return df.mapInArrow(run, df.schema)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the common words of a task; emptied when it has grown large."""

    LIMIT = 400_000

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windowed(values: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``width`` values, built by doubling."""
    if len(values) < width:
        return np.empty(0, dtype=np.uint64)
    have, size, power = values, 1, factor
    for bit in bin(width)[3:]:
        have = have[:-size] * np.uint64(power) + have[size:]
        size, power = 2 * size, power * power % 2**64
        if bit == "1":
            have = have[:-1] * np.uint64(factor) + values[size:]
            size, power = size + 1, power * factor % 2**64
    return have


def crc32_of(id_col: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8"))
