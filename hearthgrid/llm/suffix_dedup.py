"""Repeated byte strings by longest-previous-factor arrays over a dealt suffix order.

A factor of ``length`` bytes is a repeat when it also starts in an earlier document. All suffixes of a
corpus cannot stand in one array, so they are dealt out by content first: every window of ``length``
bytes has an anchor, the grams of ``GRAM`` bytes with the least hash in it, and equal windows have
equal anchors. Two rounds follow.

1. Anchors meet by hash, each with a hash of all bytes that its windows can reach. Where that whole
   context stands in an earlier document too, all windows of the anchor repeat. An anchor found in one
   document, or in one context only, needs nothing more.
2. For the rest, one stretch of text per anchor and context is sent to the bucket of the anchor. There
   the suffixes are put into their order to a depth of ``length`` bytes, ties by document. The
   previous smaller position in that order (an earlier document) shares the longest previous factor;
   the next smaller one never shares more, as ties are in the order of the documents. A factor of
   ``length`` bytes or more marks the window.

Inside a block of texts, contexts are settled at once and sent once, so copies held by a third of all
texts cost one entry per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bucket_count, in_arrow, mixed, query, store, table, text_bytes, windowed
from .packing import pack, runs, steps, unpack
from .substring_dedup import _blocks, _keyed, _long, _short

LENGTH, GRAM, BLOCK_BYTES, GROUP_BYTES = 50, 16, 2_000_000, 500_000
ANCHOR_BYTES, CONTEXT_BYTES = 5, 6
SENT_BYTES, SPLIT = 8_000_000, 16  # stretches held before they are sent; buckets of the second round per bucket of the first
_TOP = np.uint64(2**64 - 1)
_SYMBOLS = mixed(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # 256 byte values and the gap


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum (``least``) of every run of ``width`` values."""
    have, size = values, 1
    while size * 2 <= width:
        have = least(have[:-size], have[size:])
        size *= 2
    return least(have[:len(have) - (width - size)], have[width - size:]) if size < width else have


def _anchors(texts: list[bytes], length: int):
    """Layout of texts with gaps between them, and their anchors.

    Returns (start of each text in the layout, gram hashes, least hash of each window or 0, raw gram
    hashes, anchor positions in the layout, text of each anchor).
    """
    gap = length
    sizes = np.array([len(t) for t in texts])
    starts = gap + np.cumsum(sizes + gap) - (sizes + gap)
    symbols = np.full(int((sizes + gap).sum()) + gap, 256, dtype=np.int16)
    for s, t in zip(starts.tolist(), texts):
        symbols[s:s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    raw = windowed(_SYMBOLS[symbols], GRAM)
    # a position is usable if the stretch behind it does not touch a gap
    to_gap = np.zeros(len(symbols) + 1, dtype=np.int32)
    np.cumsum(symbols == 256, out=to_gap[1:])
    least = mixed(raw)
    least[to_gap[GRAM:] - to_gap[:-GRAM] > 0] = _TOP
    window = _sliding(least, length - GRAM + 1, np.minimum)
    window[to_gap[length:] - to_gap[:-length] > 0] = 0
    reach = length - GRAM
    padded = np.zeros(len(least) + reach, dtype=np.uint64)
    padded[reach:reach + len(window)] = window
    at = np.nonzero((_sliding(padded, reach + 1, np.maximum) == least) & (least != _TOP))[0]
    return starts, least, window, raw, at, np.searchsorted(starts, at, side="right") - 1


def _contexts(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of all bytes that a window with the anchor can reach, gaps included."""
    reach = length - GRAM
    total = np.zeros(len(at), dtype=np.uint64)
    for k, offset in enumerate([*range(-reach, reach, GRAM), reach]):
        total += raw[at + offset] * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x2545F4914F6CDD1D * k & 2**64 - 1 | 1)
    return mixed(total)


def _settle(anchor, context, kid):
    """For entries sorted as given: 1 if an earlier document has the context, 2 if only other contexts, else 0."""
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    some = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    code = np.zeros(len(anchor), dtype=np.int64)
    if not len(some):
        return code
    some = some[np.lexsort((kid[some], context[some], anchor[some]))]
    a, c, k = anchor[some], context[some], kid[some]
    first = runs(a, c)
    low = np.repeat(k[first], np.diff(np.r_[first, len(a)]))
    copied = k > low
    # what is left of an anchor matters if it lies in several documents
    left = ~copied
    group = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    most = np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, group[left], k[left])
    np.maximum.at(most, group[left], k[left])
    code[some] = np.where(copied, 1, np.where((least < most)[group], 2, 0))
    return code


def anchor_codes(keyed: DataFrame, length: int, block_bytes: int, buckets: int) -> DataFrame:
    """kid, th, codes: per text the packed positions of the anchors that repeat, with code 1 or 2."""
    width = ANCHOR_BYTES + CONTEXT_BYTES

    def send(batches):
        for block in _blocks(batches, block_bytes):
            kids, ths = (np.array([r[c] for r in block], dtype=np.int64) for c in (0, 1))
            starts, least, _, raw, at, doc = _anchors([r[2] for r in block], length)
            if not len(at):
                continue
            told = xxhash.xxh64_intdigest(kids.tobytes() + ths.tobytes()) >> 1
            anchor, context, where = least[at], _contexts(raw, at, length), at - starts[doc]
            local = _settle(anchor, context, kids[doc]) == 1
            # the keys of the texts go once per block; entries name a text by its place in the block
            yield {"bucket": [int(told % buckets)], "block": [told], "docs": [pack(kids, ths)], "hashes": [b""], "at": [b""], "places": [
                pack(doc[local], where[local], np.ones(int(local.sum()), dtype=np.int64))]}
            sent = np.nonzero(~local)[0]
            bucket = (anchor[sent] >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = runs(bucket[by])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(by)].tolist()):
                e = sent[by[a:b]]
                first = runs(doc[e])
                d = doc[e[first]]
                both = np.concatenate((anchor[e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES],
                                       context[e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CONTEXT_BYTES]), axis=1)
                yield {"bucket": [int(bucket[by[a]])], "block": [told], "docs": [None], "hashes": [both.tobytes()],
                       "places": [pack(steps(kids[d]), steps(d), np.diff(np.r_[first, len(e)]))], "at": [zstandard.compress(_short(steps(where[e])), 1)]}

    def meet(group: pa.Table) -> pa.Table:
        out, seen = [], [[] for _ in range(6)]
        for block, docs, hashes, places, at in zip(*(group[c].to_pylist() for c in ("block", "docs", "hashes", "places", "at"))):
            if docs is not None:
                out.append((block, docs, places))
                continue
            both = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, width)
            k, d, n = unpack(places)
            wide = np.zeros((len(both), 16), dtype=np.uint8)
            wide[:, :ANCHOR_BYTES], wide[:, 8:8 + CONTEXT_BYTES] = both[:, :ANCHOR_BYTES], both[:, ANCHOR_BYTES:]
            pair = wide.view("<u8")
            for to, values in zip(seen, (pair[:, 0], pair[:, 1], np.repeat(np.cumsum(k), n), np.repeat(np.cumsum(d), n),
                                         np.cumsum(_long(zstandard.decompress(at))), np.full(len(both), block))):
                to.append(values)
        if seen[0]:
            anchor, context, kid, doc, at, blk = (np.concatenate(s) for s in seen)
            code = _settle(anchor, context, kid)
            some = np.nonzero(code)[0]
            some = some[np.argsort(blk[some], kind="stable")]
            cuts = runs(blk[some])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(some)].tolist()):
                e = some[a:b]
                out.append((int(blk[e[0]]), None, pack(doc[e], at[e], code[e])))
        columns = zip(*out) if out else ((), (), ())
        return pa.table({c: pa.array(v, type=t) for c, v, t in zip(("block", "docs", "places"), columns, (pa.int64(), pa.binary(), pa.binary()))})

    def regroup(group: pa.Table) -> pa.Table:
        kids, ths = unpack(next(d for d in group["docs"].to_pylist() if d is not None))  # blocks of one id hold the same texts
        doc, at, code = (np.concatenate(c) for c in zip(*(unpack(p) for p in group["places"].to_pylist())))
        order = np.lexsort((at, doc))
        doc, at, code = (c[order] for c in (doc, at, code))
        cuts = runs(doc)
        return pa.table({"kid": kids[doc[cuts]], "th": ths[doc[cuts]], "codes": pa.array(
            [pack(at[a:b], code[a:b]) for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(at)].tolist())], type=pa.binary())})

    sent = in_arrow(keyed.select("kid", "th", "text"), send, "bucket int, block long, docs binary, hashes binary, places binary, at binary")
    met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "block long, docs binary, places binary")
    return met.groupBy("block").applyInArrow(regroup, "kid long, th long, codes binary").groupBy("kid", "th").agg(F.first("codes").alias("codes"))


def _expand(texts: DataFrame, codes: DataFrame, length: int, buckets: int) -> DataFrame:
    """Bucket -1: marked window starts of a text (kid, th, blob). Others: stretches that need the suffix order."""
    reach = length - GRAM

    def rows_of(marked, sent):
        rows = [(-1, *m) for m in marked]
        for bucket, pieces in sent.items():
            kid, th, low, parts = zip(*pieces)
            rows.append((bucket, 0, 0, pack(np.array(kid), np.array(th), np.array(low), np.array([len(p) for p in parts])) + b"".join(parts)))
        return {c: [r[k] for r in rows] for k, c in enumerate(("bucket", "kid", "th", "blob"))}

    def places(group, marked, sent) -> int:
        """Marked windows and stretches of some texts (kid, th, text, positions, codes); the bytes added to ``sent``."""
        kids, ths, own, where, code = zip(*group)
        starts, least, window, _, _, _ = _anchors(list(own), length)
        doc = np.repeat(np.arange(len(own)), [len(w) for w in where])
        where, code = np.concatenate(where), np.concatenate(code)
        at = where + starts[doc]
        low, high = np.empty_like(where), np.empty_like(where)
        for c in range(0, len(at), 50_000):
            s = slice(c, c + 50_000)
            # windows whose least hash is that of the anchor: one run around it
            near = window[at[s, None] + np.arange(-reach, 1)] == least[at[s]][:, None]
            low[s], high[s] = where[s] + np.argmax(near, axis=1) - reach, where[s] - np.argmax(near[:, ::-1], axis=1)
        one = np.nonzero(code == 1)[0]
        cuts = runs(doc[one])
        for e in np.split(one, cuts[1:]) if len(one) else ():
            marked.append((kids[doc[e[0]]], ths[doc[e[0]]], pack(low[e], high[e] - low[e] + 1)))
        rest, held = np.nonzero(code != 1)[0], 0
        to = (least[at[rest]] % np.uint64(buckets)).tolist()
        for bucket, d, a, b in zip(to, doc[rest].tolist(), low[rest].tolist(), high[rest].tolist()):
            part = own[d][a:b + length]
            sent.setdefault(bucket, []).append((kids[d], ths[d], a, part))
            held += len(part)
        return held

    def run(batches):
        marked, sent, held, group, size = [], {}, 0, [], 0
        for b in batches:
            for kid, th, packed, blob in zip(b["kid"], b["th"], b["packed"], b["codes"]):
                group.append((kid, th, zstandard.decompress(packed), *unpack(blob)))
                size += len(group[-1][2])
                if size >= GROUP_BYTES:
                    held += places(group, marked, sent)
                    group, size = [], 0
            if held >= SENT_BYTES or len(marked) >= 2000:
                yield rows_of(marked, sent)
                marked, sent, held = [], {}, 0
        if group:
            places(group, marked, sent)
        yield rows_of(marked, sent)
    joined = texts.join(codes, ["kid", "th"]).select("kid", "th", "packed", "codes")
    return in_arrow(joined, run, "bucket int, kid long, th long, blob binary")


def previous_factors(parts: list[bytes], kid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of the windows of ``length`` bytes that a part of smaller kid holds as well.

    Windows whose hash stands in one document only share no factor of that length and leave first; the
    suffixes at the others are put into their order to that depth by their bytes, eight at a time.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    joint = np.frombuffer(b"".join(parts), dtype=np.uint8)
    hashes = windowed(_SYMBOLS[joint], length)
    # starts of the windows that lie inside one part
    n = np.maximum(sizes - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), n)
    start = np.arange(len(part)) + (ends - sizes - np.cumsum(n) + n)[part]
    hashes, own = hashes[start], kid[part]
    order = np.argsort(hashes)
    first = runs(hashes[order])
    low, high = (np.repeat(f.reduceat(own[order], first), np.diff(np.r_[first, len(order)])) if len(order) else own
                 for f in (np.minimum, np.maximum))
    some = order[low < high]
    start, part, own = start[some], part[some], own[some]
    words = np.lib.stride_tricks.sliding_window_view(joint, 8) if len(joint) >= 8 else np.empty((0, 8), dtype=np.uint8)
    columns = [np.ascontiguousarray(words[start + at]).view(">u8").ravel().astype(np.uint64) for at in [*range(0, length - 8, 8), length - 8]]
    order = np.lexsort((own, *columns[::-1]))  # suffix order, ties by document
    first = runs(*(c[order] for c in columns))
    previous = np.repeat(own[order[first]], np.diff(np.r_[first, len(order)]))
    marked = order[own[order] > previous]
    return part[marked], (start - (ends - sizes)[part])[marked]


def marked_windows(pieces: DataFrame, length: int, buckets: int) -> DataFrame:
    """kid, th, blob: window starts with a previous factor of the full length, from the stretches of each bucket."""
    def run(group: pa.Table) -> pa.Table:
        seen, parts = [], []
        for blob in group["blob"].to_pylist():
            d = zstandard.ZstdDecompressor().decompressobj()
            head = d.decompress(blob)  # noqa: F841  the packed columns come first, the bytes follow them
            rest = d.unused_data
            columns = unpack(blob[:len(blob) - len(rest)])
            seen.append(columns)
            ends = np.cumsum(columns[3])
            parts += [rest[a:b] for a, b in zip((ends - columns[3]).tolist(), ends.tolist())]
        kid, th, low, _ = (np.concatenate(c) for c in zip(*seen))
        # equal stretches are ranked once, for the earliest document that has them; later documents repeat all of it
        lowest: dict[bytes, int] = {}
        for k, p in zip(kid.tolist(), parts):
            lowest[p] = min(k, lowest.get(p, k))
        distinct = list(lowest)
        part, offset = previous_factors(distinct, np.array([lowest[p] for p in distinct]), length)
        by = np.lexsort((offset, part))
        part, offset = part[by], offset[by]
        cuts = runs(part, offset - np.arange(len(offset)))
        n = np.diff(np.r_[cuts, len(offset)])
        of: dict[bytes, list] = {}
        for p, o, m in zip(part[cuts].tolist(), offset[cuts].tolist(), n.tolist()):
            of.setdefault(distinct[p], []).append((o, m))
        rows = []
        for k, t, l, p in zip(kid.tolist(), th.tolist(), low.tolist(), parts):
            found = [(0, len(p) - length + 1)] if k > lowest[p] else of.get(p, ())
            rows += [(k, t, l + o, m) for o, m in found]
        rows.sort()
        k, t, s, m = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(4))
        cuts = runs(k, t)
        return pa.table({"kid": k[cuts], "th": t[cuts], "blob": pa.array(
            [pack(s[a:b], m[a:b]) for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(k)].tolist())], type=pa.binary())})
    return pieces.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "kid long, th long, blob binary")


def cut_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                block_bytes: int = BLOCK_BYTES, with_bytes: bool = False) -> DataFrame:
    """Remove every byte inside a string of ``length`` bytes that also starts in a document of smaller id.

    Columns id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes); one row per
    input row. Texts are UTF-8 bytes, null is empty; matches lie inside one text. Rows of equal id are
    not earlier than each other, a null id is the smallest. Texts shorter than ``length`` keep all.
    Repeated rows give equal results; extra columns are not read; an empty table gives an empty one.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be above {GRAM}")
    keyed = _keyed(docs, id_col, text_col)
    buckets = bucket_count(docs.sparkSession, text_bytes(keyed))

    def shrink(batches):
        for b in batches:
            yield {"id": b["id"], "kid": b["kid"], "th": b["th"], "packed": [zstandard.compress(t, 3) for t in b["text"]]}
    texts = in_arrow(keyed, shrink, "id long, kid long, th long, packed binary")
    codes = anchor_codes(keyed, length, block_bytes, buckets)
    open_ = store(_expand(texts, codes, length, SPLIT * buckets), "stretches")
    marked = open_.filter("bucket < 0").select("kid", "th", "blob").unionByName(marked_windows(open_.filter("bucket >= 0").select("bucket", "blob"), length, buckets))
    cut = marked.groupBy("kid", "th").agg(F.collect_list("blob").alias("blobs"))

    def finish(batches):
        for b in batches:
            out = {c: [] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, packed, blobs in zip(b["id"], b["packed"], b["blobs"]):
                text = zstandard.decompress(packed)
                kept, spans = text, 0
                if blobs:
                    start, n = (np.concatenate(c) for c in zip(*(unpack(x) for x in blobs)))
                    cover = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n + length - 1, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                out["id"].append(i)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_bytes else None)
            yield out
    done = in_arrow(texts.join(cut, ["kid", "th"], "left").select("id", "packed", "blobs"), finish,
                    "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_bytes else done.drop("kept")


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return cut_factors(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
