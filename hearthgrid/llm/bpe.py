"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join.

Texts are split in blocks. A block keeps its distinct words once and its texts as positions in that
list. The word lists of all blocks are dealt out by a hash of the word, so equal words meet: each
distinct word is encoded once. The ids then join back to the blocks, and every text takes them by
position. Only word lists and positions move, packed per block and bucket; a word that every text
holds is one entry per block, so no word is a hot key.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import bucket_count, in_arrow, key_and_bytes, query, table, text_bytes
from .wordpieces import byte_letters, public_path, read_tokenizer, splitter

BLOCK_BYTES = 8_000_000


class _Places(dict):
    """Word -> its position in the block's list, given in order of first sight."""

    def __missing__(self, word):
        place = self[word] = len(self)
        return place


def _joined(words: list[str]) -> bytes:
    """Words in one string of bytes; no UTF-8 text holds the separator."""
    return b"\xff".join([w.encode() for w in words])


def _listed(blob: bytes) -> list[str]:
    raw = zstandard.decompress(blob)
    return [w.decode() for w in raw.split(b"\xff")] if raw else []


def _packed(*arrays: np.ndarray) -> bytes:
    """Integers as compressed byte planes, each array behind its length."""
    head = np.array([len(a) for a in arrays], dtype="<u4").tobytes()
    planes = [np.ascontiguousarray(np.asarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.compress(len(arrays).to_bytes(4, "little") + head + b"".join(planes), 3)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, dtype="<u4", count=count, offset=4).tolist()
    out, at = [], 4 + 4 * count
    for n in sizes:
        planes = np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * n
    return out


def _buckets(words: list[str], count: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % count for w in words), dtype=np.int64, count=len(words))


def _blocks(batches, spec: str, size: int, positions: bool = True):
    """Yield (block id, doc ids, positions per doc if wanted, word list). The block id is a hash of its content and place."""
    words, part = splitter(spec), TaskContext.get().partitionId()
    ids, codes, places, held = [], [], _Places(), 0

    def block():
        listed = list(places)
        told = xxhash.xxh64(_joined(listed))
        told.update(repr((part, ids[:1], len(ids))))
        return told.intdigest() >> 1, ids, codes, listed
    for b in batches:
        for i, text in zip(b["id"], b["text"]):
            ids.append(i)
            found = words.words(text.decode("utf-8", "replace"))
            if positions:
                found = [np.fromiter(map(places.__getitem__, w), dtype="<u4", count=len(w)) for w in found]
                codes.append(np.concatenate(found) if len(found) != 1 else found[0])
            else:
                for w in found:
                    places.update(dict.fromkeys(w))  # keeps the order of first sight
            held += len(text)
            if held >= size:
                yield block()
                ids, codes, places, held = [], [], _Places(), 0
    if ids:
        yield block()


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns id, ids (array of int): the ids of every whole text, one row per input row.

    Null and empty texts give an empty array. Repeated rows and null ids keep one row each, extra
    columns are not read, an empty table gives an empty result. Strings of special tokens inside a
    text become their ids, as in the tokenizers library.
    """
    spec = read_tokenizer(tokenizer_file)
    spark = docs.sparkSession
    rows = key_and_bytes(docs, id_col, text_col)
    count = bucket_count(spark, text_bytes(rows))

    def lists(batches):
        for block, _, _, listed in _blocks(batches, spec, block_bytes, positions=False):
            where = _buckets(listed, count)
            order = np.argsort(where, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(where[order]))[0] + 1):
                if len(part):
                    blob = _joined([listed[k] for k in part.tolist()])
                    yield {"bucket": [int(where[part[0]])], "block": [block], "sum": [zlib.crc32(blob)], "words": [zstandard.compress(blob, 3)]}

    def encode(group: pa.Table) -> pa.Table:
        """All lists of one bucket: each distinct word is encoded once."""
        words = splitter(spec)
        listed = [_listed(w) for w in group["words"].to_pylist()]
        distinct = list(set().union(*listed))
        ids = {}
        for at in range(0, len(distinct), 20_000):
            some = distinct[at:at + 20_000]
            ids.update(zip(some, words.encode_words(some)))
        out = []
        for own in listed:
            raw = [ids[w] for w in own]
            lengths = np.fromiter(map(len, raw), dtype="<u4", count=len(raw)) // words.width
            out.append(_packed(lengths, np.frombuffer(b"".join(raw), dtype=f"<u{words.width}")))
        return pa.table({"block": group["block"], "bucket": group["bucket"], "sum": group["sum"], "ids": pa.array(out, type=pa.binary())})

    def texts(batches):
        for block, ids, codes, listed in _blocks(batches, spec, block_bytes):
            yield {"block": [block], "docs": [pa.array(ids, type=pa.int64()).to_pylist()],
                   "codes": [_packed(np.array([len(c) for c in codes]), np.concatenate(codes))],
                   "listed": [zstandard.compress(_joined(listed), 3)]}

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """Give the texts of one block their ids."""
        words, schema = splitter(spec), pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        got = {(b, s): i for b, s, i in zip(right["bucket"].to_pylist(), right["sum"].to_pylist(), right["ids"].to_pylist())}
        out_docs, out_values, out_sizes = [], [], []
        for docs_, codes, listed in zip(left["docs"].to_pylist(), left["codes"].to_pylist(), left["listed"].to_pylist()):
            listed = _listed(listed)
            sizes, codes = _unpacked(codes)
            where = _buckets(listed, count)
            order = np.argsort(where, kind="stable")
            lengths = np.zeros(len(listed), dtype=np.int64)
            parts, values = np.split(order, np.nonzero(np.diff(where[order]))[0] + 1) if len(listed) else [], []
            for part in parts:
                own = [listed[k] for k in part.tolist()]
                key = (int(where[part[0]]), zlib.crc32(_joined(own)))
                if key in got:
                    lengths[part], ids = _unpacked(got[key])
                else:  # the input changed between its two reads: these words are not in the table
                    raw = words.encode_words(own)
                    lengths[part] = [len(r) // words.width for r in raw]
                    ids = np.frombuffer(b"".join(raw), dtype=f"<u{words.width}")
                values.append(ids.astype(np.int32))
            values = np.concatenate(values) if values else np.empty(0, np.int32)
            starts = np.zeros(len(listed), dtype=np.int64)
            starts[order] = np.r_[0, np.cumsum(lengths[order])[:-1]] if len(listed) else []
            n = lengths[codes]
            first = np.cumsum(n) - n
            total = int(n.sum())
            out_values.append(values[np.repeat(starts[codes] - first, n) + np.arange(total)] if total else np.empty(0, np.int32))
            bounds = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)].astype(np.int64)]
            out_sizes.append(np.diff(bounds))
            out_docs += docs_
        if not out_docs:
            return schema.empty_table()
        offsets = np.r_[0, np.cumsum(np.concatenate(out_sizes))].astype(np.int32)
        return pa.table([pa.array(out_docs, type=pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out_values)))],
                        schema=schema)

    listed = in_arrow(rows, lists, "bucket int, block long, sum long, words binary")
    known = listed.repartition(count, "bucket").groupBy("bucket").applyInArrow(encode, "block long, bucket int, sum long, ids binary")
    coded = in_arrow(rows, texts, "block long, docs array<long>, codes binary, listed binary")
    return coded.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(place, "id long, ids array<int>")


def pieces_of(tokenizer_file: str) -> tuple[list[str | None], bool]:
    """The id-to-piece table (index = id), and whether pieces are byte-level."""
    words = splitter(read_tokenizer(tokenizer_file))
    size = words.tokenizer.get_vocab_size()
    kind = type(words.tokenizer.decoder).__name__ if words.tokenizer.decoder is not None else None
    if kind not in (None, "ByteLevel"):
        raise ValueError(f"decoder {kind} is not supported")
    return [words.tokenizer.id_to_token(i) for i in range(size)], kind == "ByteLevel"


def decode_documents(encoded: DataFrame, tokenizer_file: str, digests: bool = False) -> DataFrame:
    """Columns id, ids, decoded (with ``digests``: id, n_tokens and the SHA-256 of ids and decoded text instead).

    The id-to-piece table has one row per id of the vocabulary and is sent to every task. A null
    array decodes to the empty text; an id outside the table adds nothing.
    """
    pieces, byte_level = pieces_of(tokenizer_file)
    if len(pieces) > 2_000_000:
        raise ValueError("the vocabulary is too large to be sent to every task")
    letters = byte_letters()
    raw = [b"" if p is None else (bytes(letters[c] for c in p) if byte_level and all(c in letters for c in p) else p.encode()) for p in pieces]
    joint = b"" if byte_level else b" "

    def text_of(ids: np.ndarray) -> bytes:
        inside = ids if not len(ids) or 0 <= ids.min() and ids.max() < len(raw) else ids[(ids >= 0) & (ids < len(raw))]
        found = joint.join(map(raw.__getitem__, inside.tolist()))
        return found.decode("utf-8", "replace").encode() if byte_level else found

    def run(batches):
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("ids"))
            values = listed.values.to_numpy(zero_copy_only=False)
            starts = listed.offsets.to_numpy()
            ids = [values[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist())]
            out = {"id": batch.column(batch.schema.get_field_index("id"))}
            if digests:
                out |= {"n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(text_of(i)).hexdigest() for i in ids], pa.string())}
            else:
                out |= {"ids": listed, "decoded": pa.array([text_of(i).decode() for i in ids], pa.string())}
            yield pa.RecordBatch.from_pydict(out)
    ship_package(encoded.sparkSession)
    rows = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids array<int>, decoded string")


@query("op7_bpe_encode_decode")
def op7(spark, sf_dir):
    file = public_path("word_bpe_49k.json")
    done = decode_documents(encode_documents(table(spark, sf_dir, "documents"), file), file, digests=True)
    return done.withColumnRenamed("id", "doc_id")
