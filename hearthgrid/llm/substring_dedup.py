"""Repeated word sequences by De Bruijn compaction.

Every run of ``window`` words is an edge of the De Bruijn graph between its first and its last
window - 1 words. Equal edges meet by their hash; the first place of an edge in the corpus is its
source, every other place is a repeat. Where successive edges of a text repeat successive edges of
one source, the path between them does not branch: such paths are compacted into spans (start,
length, source, start in the source). Spans join the texts by document, once as the place to cut and
once as the source to look up, and a digest of the words on both sides verifies every span.

Only hashes move before the spans are known, packed per block of texts and bucket of hashes. Inside a
block the repeats of an edge are settled at once and only its first place is sent, so a passage that
a third of all texts hold costs one entry per block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, bucket_count, in_arrow, key_and_bytes, mixed, query, store, table, text_bytes, windowed
from .packing import pack, runs, steps, unpack

WINDOW, BLOCK_BYTES, ATTEMPTS = 20, 8_000_000, 4
_NO_ID = -2**63


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, text, and the key of a row: its id (null first) and a hash of its text, as ids may repeat."""
    return key_and_bytes(docs, id_col, text_col, *more).withColumns({
        "kid": F.coalesce("id", F.lit(_NO_ID)), "th": F.xxhash64("text")})


def _blocks(batches, size: int):
    """Lists (kid, th, text) of bounded total length, in the order of kid."""
    block, held = [], 0
    for b in batches:
        for row in zip(b["kid"], b["th"], b["text"]):
            block.append(row)
            held += len(row[2])
            if held >= size:
                yield sorted(block, key=lambda r: r[:2])
                block, held = [], 0
    if block:
        yield sorted(block, key=lambda r: r[:2])


def _edges(block, window: int, seed: int):
    """Arrays document index, position and two independent hashes of all edges of a block, in order."""
    words = WordHashes(seed)
    hashed = [words.of(text.split()) for _, _, text in block]
    sizes = np.array([len(h) for h in hashed])
    joint = np.concatenate(hashed)
    h, more = mixed(windowed(joint, window)), mixed(windowed(mixed(joint), window, 0xD6E8FEB86659FD93))
    doc = np.repeat(np.arange(len(block)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(len(doc)) - (ends - sizes)[doc]
    if not len(h):
        return doc[:0], at[:0], h, more
    inside = np.nonzero(at[:len(h)] + window <= sizes[doc[:len(h)]])[0]
    return doc[inside], at[inside], h[inside], more[inside]


def _repeats(h, more, kid, at):
    """Index pairs (repeat, source): entries behind the first place (kid, position) of their hashes, and that place."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    some = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order  # few entries share a hash
    some = some[np.lexsort((at[some], kid[some], more[some], h[some]))]
    starts = runs(h[some], more[some])
    first = np.repeat(some[starts], np.diff(np.r_[starts, len(some)]))
    later = (kid[some] != kid[first]) | (at[some] != at[first])
    return some[later], first[later]


def repeated_paths(keyed: DataFrame, window: int, seed: int, block_bytes: int, hash_bytes: int, buckets: int) -> DataFrame:
    """Spans kid, th, start, edges, skid, sth, sstart: paths that repeat a path of an earlier source."""

    def send(batches):
        for block in _blocks(batches, block_bytes):
            kids, ths = (np.array([r[c] for r in block], dtype=np.int64) for c in (0, 1))
            doc, at, h, more = _edges(block, window, seed)
            if not len(h):
                continue
            told = xxhash.xxh64_intdigest(kids.tobytes() + ths.tobytes()) >> 1
            own, src = _repeats(h, more, kids[doc], at)
            sent = np.ones(len(h), dtype=bool)
            sent[own] = False
            if len(own):
                by = np.argsort(own)
                own, src = own[by], src[by]
                yield {"bucket": [int(told % buckets)], "block": [told], "local": [True], "hashes": [b""], "at": [b""], "places": [
                    pack(kids[doc[own]], ths[doc[own]], at[own], kids[doc[src]], ths[doc[src]], at[src] - at[own])]}
            sent = np.nonzero(sent)[0]
            bucket = (h[sent] >> np.uint64(40)) % np.uint64(buckets)  # the top byte goes into the choice of the bucket
            by = np.argsort(bucket, kind="stable")
            cuts = runs(bucket[by])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(by)].tolist()):
                e = sent[by[a:b]]
                first_of = runs(doc[e])
                n = np.diff(np.r_[first_of, len(e)])
                d = doc[e[first_of]]
                raw = np.stack((h[e], more[e]), axis=1).astype("<u8").view(np.uint8)[:, :hash_bytes]
                yield {"bucket": [int(bucket[by[a]])], "block": [told], "local": [False], "hashes": [raw.tobytes()],
                       "places": [pack(kids[d], ths[d], n)],
                       "at": [zstandard.compress(_short(steps(at[e])), 1)]}

    def meet(group: pa.Table) -> pa.Table:
        """All entries of one bucket: the repeats of every edge, with their source."""
        blocks, out = [], []
        hs, kid, th, at, blk = [], [], [], [], []
        for block, local, hashes, places, steps_ in zip(*(group[c].to_pylist() for c in ("block", "local", "hashes", "places", "at"))):
            if local:
                blocks.append(block)
                out.append(places)
                continue
            raw = np.zeros((len(hashes) // hash_bytes, 16), dtype=np.uint8)
            raw[:, :hash_bytes] = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, hash_bytes)
            k, t, n = unpack(places)
            hs.append(raw.view("<u8"))
            kid.append(np.repeat(k, n))
            th.append(np.repeat(t, n))
            at.append(np.cumsum(_long(zstandard.decompress(steps_))))
            blk.append(np.full(len(hs[-1]), block))
        if hs:
            both, kid, th, at, blk = (np.concatenate(x) for x in (hs, kid, th, at, blk))
            h, more = both[:, 0], both[:, 1]
            del hs
            own, src = _repeats(h, more, kid, at)
            by = np.lexsort((at[own], kid[own], blk[own]))
            own, src = own[by], src[by]
            cuts = runs(blk[own])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(own)].tolist()):
                o, s = own[a:b], src[a:b]
                blocks.append(int(blk[o[0]]))
                out.append(pack(kid[o], th[o], at[o], kid[s], th[s], at[s] - at[o]))
        return pa.table({"block": pa.array(blocks, type=pa.int64()), "places": pa.array(out, type=pa.binary())})

    def compact(group: pa.Table) -> pa.Table:
        """Successive repeats of successive edges of one source become one path."""
        parts = [unpack(p) for p in group["places"].to_pylist()]
        kid, th, at, skid, sth, shift = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((at, th, kid))
        kid, th, at, skid, sth, shift = (c[order] for c in (kid, th, at, skid, sth, shift))
        starts = runs(kid, th, skid, sth, shift, at - np.arange(len(at)))
        return pa.table({"kid": kid[starts], "th": th[starts], "start": at[starts], "edges": np.diff(np.r_[starts, len(at)]),
                         "skid": skid[starts], "sth": sth[starts], "sstart": at[starts] + shift[starts]})

    sent = in_arrow(keyed.select("kid", "th", "text"), send, "bucket int, block long, local boolean, hashes binary, places binary, at binary")
    met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "block long, places binary")
    return met.groupBy("block").applyInArrow(compact, "kid long, th long, start long, edges long, skid long, sth long, sstart long")


def _short(values: np.ndarray) -> bytes:
    v = values.astype("<i4")
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes()


def _long(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = 17,
                block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Remove every word in a run of ``window`` words that also starts earlier in the corpus.

    Columns id, n_words, n_removed, kept_sha256 (``with_text`` adds the row key kid, th and kept, the
    kept words joined by one space); one row per input row. Earlier means a smaller id, or the same id and an earlier start; rows of equal
    id count as one document, a null id as the smallest. Words are runs of bytes other than ASCII
    white space, unchanged. Null and empty texts have no words; texts shorter than a run keep all.
    Repeated rows give equal results; extra columns are not read; an empty table gives an empty one.

    The hashes are as wide as the number of words asks for. Should a digest still show that two
    different runs share one, the work is repeated with another seed and wider hashes.
    """
    keyed = _keyed(docs, id_col, text_col)
    size = text_bytes(keyed)
    # two of n edges share b bits with a chance of n * n / 2^(b + 1); about b - 6 bits for an n of size / 4
    width = min(16, max(6, math.ceil((2 * math.log2(size / 4 + 2)) / 8)))
    for attempt in range(ATTEMPTS):
        done = _cut(keyed, window, seed + attempt, block_bytes, min(16, width + attempt), bucket_count(docs.sparkSession, size), with_text)
        if done is not None:
            return done
    raise RuntimeError("different word runs share hashes for every seed")


def _cut(keyed: DataFrame, window: int, seed: int, block_bytes: int, hash_bytes: int, buckets: int, with_text: bool) -> DataFrame | None:
    """One attempt; None if a digest does not agree."""
    spans = store(repeated_paths(keyed, window, seed, block_bytes, hash_bytes, buckets), "paths")
    cut = spans.groupBy("kid", "th").agg(F.collect_list(F.struct("start", "edges", "skid", "sth", "sstart")).alias("cut"))
    asked = spans.select(F.col("skid").alias("kid"), F.col("sth").alias("th"), F.col("sstart").alias("start"), "edges").distinct().groupBy(
        "kid", "th").agg(F.collect_list(F.struct("start", "edges")).alias("asked"))

    def shrink(batches):
        for b in batches:
            yield {"id": b["id"], "kid": b["kid"], "th": b["th"], "packed": [zstandard.compress(t, 1) for t in b["text"]]}
    texts = in_arrow(keyed, shrink, "id long, kid long, th long, packed binary")

    def digest(words, start, edges):
        return xxhash.xxh3_64_intdigest(b" ".join(words[start:start + edges + window - 1])) >> 1

    def finish(batches):
        for b in batches:
            out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept", "own", "asked")} | {c: b[c] for c in ("id", "kid", "th")}
            for kid, th, packed, cut_, asked_ in zip(*(b[c] for c in ("kid", "th", "packed", "cut", "asked"))):
                words = zstandard.decompress(packed).split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in cut_ or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["edges"] + window - 1] -= 1
                left = np.nonzero(np.cumsum(gone)[:-1] == 0)[0]
                kept = b" ".join([words[k] for k in left.tolist()]) if len(left) < len(words) else b" ".join(words)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "replace") if with_text else None)
                out["own"].append([{"kid": s["skid"], "th": s["sth"], "start": s["sstart"], "edges": s["edges"],
                                    "sum": digest(words, s["start"], s["edges"])} for s in cut_ or ()])
                out["asked"].append([{"kid": kid, "th": th, "start": s["start"], "edges": s["edges"],
                                      "sum": digest(words, s["start"], s["edges"])} for s in asked_ or ()])
            yield out

    joined = texts.join(cut, ["kid", "th"], "left").join(asked, ["kid", "th"], "left").select("id", "kid", "th", "packed", "cut", "asked")
    place = "array<struct<kid:long,th:long,start:long,edges:long,sum:long>>"
    done = store(in_arrow(joined, finish, f"id long, kid long, th long, n_words long, n_removed long, kept_sha256 string, kept string, own {place}, asked {place}"), "cut")
    own = done.select(F.explode("own").alias("s")).select("s.*").distinct()
    source = done.select(F.explode("asked").alias("s")).select("s.*").distinct()
    if not own.join(source, ["kid", "th", "start", "edges", "sum"], "left_anti").isEmpty():
        return None
    return done.drop("own", "asked") if with_text else done.select("id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, size_col: str | None = None) -> DataFrame:
    """``docs`` with the kept words as text, other columns as they are; ``size_col`` gets the new number of characters."""
    cut = cut_repeats(docs, id_col, text_col, window, with_text=True).select(
        F.col("kid").alias("__kid"), F.col("th").alias("__th"), "kept").dropDuplicates(["__kid", "__th"])
    joined = _keyed(docs.withColumn("__row", F.struct(*[c for c in docs.columns if c != text_col])), id_col, text_col, "__row").withColumnsRenamed(
        {"kid": "__kid", "th": "__th"}).drop("id", "text").join(cut, ["__kid", "__th"])
    out = {c: F.col("kept") if c == text_col else F.col("__row")[c] for c in docs.columns}
    if size_col is not None:
        out[size_col] = F.length("kept").cast(docs.schema[size_col].dataType)
    return joined.select(*[v.alias(c) for c, v in out.items()])


@query("op1_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
run AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t FROM word),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM run WHERE pos + 20 <= n),
hit AS (SELECT doc_id, pos FROM ranked WHERE k > 1),
flag AS (SELECT word.doc_id, word.pos, word.word, max(CASE WHEN hit.pos IS NULL THEN 0 ELSE 1 END) OVER (
           PARTITION BY word.doc_id ORDER BY word.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
         FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.pos = word.pos)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(max(f.removed), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(max(f.kept), '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY pos) AS kept
                  FROM flag GROUP BY doc_id) f ON f.doc_id = d.doc_id
GROUP BY d.doc_id, d.w
""")
def op1(spark, sf_dir):
    return cut_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
