"""Token ids as flat binary files.

One file per partition, in ascending order of the document ids. A file holds

    ids        n_ids unsigned integers of ``width`` bytes (2 or 4), document after document
    doc ids    n_docs signed 64-bit integers (null: the smallest one)
    ends       n_docs 64-bit offsets: ids of the file up to the end of each document
    n_docs, n_ids, width   three 64-bit integers

all little-endian, so ids and offsets can be memory-mapped where they lie (``open_token_file``).
Where a file starts in the whole corpus is the sum of the sizes before it: a prefix sum over one
row per file.

Spark's text writer puts the bytes: a document is one row, and the separator between rows is the
zero byte with which its end id closes. No task opens a path of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from .common import in_arrow, key_and_bytes, query, store, table
from .wordpieces import public_path, read_tokenizer, splitter

PARTITION_BYTES, END_ID = 32_000_000, 0
_NULL_ID = -2**63
_TAIL = 24


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID,
                      partition_bytes: int = PARTITION_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, close it with ``end_id`` and write the files into ``path``.

    Null texts count as empty: only the end id is written. Null doc ids come first, equal ids in the
    order of their texts; every row is one document. Extra columns are not read. An empty table
    writes no document. The number of files follows the total size of the texts, so a file stays
    small however large the table is.
    """
    spec = read_tokenizer(tokenizer_file)
    rows = key_and_bytes(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    width = splitter(spec).width if end_id < 256 else 4  # the last byte of the end id must be zero
    if end_id >= 2**24:
        raise ValueError("end_id must be below 2**24")
    end = int(end_id).to_bytes(width, "little")

    def encode(batches):
        words = splitter(spec)
        ids, ends, at = [], [], 0
        for b in batches:
            out = []
            for raw in words.encode([t.decode("utf-8", "replace") for t in b["text"]]):
                if width != words.width:
                    raw = np.frombuffer(raw, dtype=f"<u{words.width}").astype(f"<u{width}").tobytes()
                at += len(raw) // width + 1
                ends.append(at)
                out.append(raw + end[:-1])
            ids.extend(_NULL_ID if i is None else i for i in b["id"])
            yield {"value": out}
        if ids:
            yield {"value": [np.array(ids + ends + [len(ids), at, width], dtype="<i8").tobytes()[:-1]]}

    placed = rows.repartitionByRange(max(1, -(-size // partition_bytes)), "id").sortWithinPartitions("id", "text")
    in_arrow(placed, encode, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def parse_token_file(content) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc ids and ends as views of the bytes of one file."""
    n, total, width = np.frombuffer(content, dtype="<i8", count=3, offset=len(content) - _TAIL)
    tail = len(content) - _TAIL - 16 * int(n)
    return (np.frombuffer(content, dtype=f"<u{width}", count=int(total)),
            np.frombuffer(content, dtype="<i8", count=int(n), offset=tail), np.frombuffer(content, dtype="<i8", count=int(n), offset=tail + 8 * int(n)))


def open_token_file(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same views over a memory-mapped local file."""
    return parse_token_file(np.memmap(path, dtype=np.uint8, mode="r"))


def read_token_index(spark, path: str) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of every document, read from the files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content")

    def read(batches):
        for b in batches:
            for part, content in zip(b["part"], b["content"]):
                ids, docs, ends = parse_token_file(content)
                starts = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield {"part": np.full(len(docs), part, dtype=np.int32), "doc_id": [None if d == _NULL_ID else d for d in docs.tolist()],
                       "at": starts, "n_tokens": ends - starts, "ids_crc32": crc}
    rows = store(in_arrow(files, read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


@query("op8_token_files")
def op8(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return read_token_index(spark, path)
