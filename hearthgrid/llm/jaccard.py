"""All pairs of texts whose word-shingle sets reach a Jaccard similarity, as links that keep every group.

Any global order of the shingles lets two sets of similarity t meet in their first |x| - ceil(t |x|) + 1
shingles (prefix filter). The order is rarest first: shingles are counted over the whole corpus, and those
of one text alone need not be sent. Texts that meet in a prefix and whose sizes allow t are linked; inside
what such links connect, sets are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import WordHashes, in_arrow, mixed, store, windowed
from .packing import pack as packed, steps, unpack

BUCKET_ENTRIES, CHUNK, COLUMNS = 1_000_000, 128, 4096


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (A-Z lowered); a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = min(width, len(words))
    return np.unique(mixed(windowed(hashes.of(words), n) + np.uint64(n)))


def prefix_length(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1


def _ascending(values: np.ndarray) -> bytes:
    """Sorted keys or places by their steps, which need far fewer bytes than the values."""
    return packed(steps(values))


def _restored(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)[0])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from every index over the given links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest index of every set's group, from the exact similarities of all pairs."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, common = np.repeat(np.arange(n), sizes), count > 1
    keep = common[inverse]
    column, owner = (np.cumsum(common) - 1)[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n))
    for at in range(0, int(common.sum()), COLUMNS):
        s, e = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((n, COLUMNS), dtype=np.float32)
        x[owner[s:e], column[s:e] - at] = 1
        shared += x @ x.T
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared)
    return forest(n, *np.nonzero(np.triu(near, 1)))


def meetings(texts: DataFrame, total: int, width: int, similarity: float, seed: int) -> DataFrame:
    """Links (a, b) that connect all texts (id, text) with a common prefix shingle and sizes within the similarity.

    ``total`` is the number of shingles. Shingles are counted by their first bytes, more of them in a larger
    corpus; two that share these only add candidates.
    """
    size = min(8, max(4, math.ceil((math.log2(total + 1) + 12) / 8)))
    buckets = max(64, total // BUCKET_ENTRIES)
    bounds = np.array([(i << 8 * size) // buckets for i in range(1, buckets)], dtype=np.uint64)

    def read(batches):
        hashes, block = WordHashes(seed), TaskContext.get().partitionId() << 32
        for b in batches:
            sets = [shingle_set(t, width, hashes) for t in b["text"]]
            keys, own, n = np.unique(np.concatenate(sets) >> np.uint64(64 - 8 * size), return_inverse=True, return_counts=True)
            yield {"block": [block], "ids": [np.array(b["id"], dtype=np.int64).tobytes()],
                   "sizes": [np.array([len(s) for s in sets], dtype=np.int64).tobytes()], "own": [_ascending(own)], "keys": [packed(steps(keys), n)]}
            block += 1
    # a text holds places in the keys of its block, which are far shorter than keys and meet no other block
    blocks = store(in_arrow(texts, read, "block long, ids binary, sizes binary, own binary, keys binary"), "shingle-blocks")

    def deal(batches):
        for b in batches:
            for block, raw in zip(b["block"], b["keys"]):
                keys, n = unpack(raw)
                keys = np.cumsum(keys).view(np.uint64)
                cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
                some = np.nonzero(np.diff(cuts))[0].tolist()
                yield {"bucket": some, "block": [block] * len(some),
                       "keys": [packed(steps(keys[cuts[i]:cuts[i + 1]]), n[cuts[i]:cuts[i + 1]]) for i in some]}

    def count(group: pa.Table) -> pa.Table:
        packs, n = zip(*(unpack(k) for k in group.column("keys").to_pylist()))
        packs = [np.cumsum(k) for k in packs]
        _, inverse = np.unique(np.concatenate(packs), return_inverse=True)
        df = np.bincount(inverse, weights=np.concatenate(n))[inverse].astype(np.int64)
        parts = np.split(df, np.cumsum([len(p) for p in packs])[:-1])
        return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "n": pa.array([packed(d) for d in parts], pa.binary()),
                         "keys": pa.array([_ascending(k[d > 1]) for k, d in zip(packs, parts)], pa.binary())})
    counted = in_arrow(blocks.select("block", "keys"), deal, "bucket long, block long, keys binary").groupBy("bucket").applyInArrow(
        count, "bucket long, block long, n binary, keys binary").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n", "keys"))).alias("packs")).select(
        "block", F.col("packs.n").alias("n"), F.col("packs.keys").alias("keys"))

    def choose(batches):
        for b in batches:
            for ids, sizes, own, n, keys in zip(b["ids"], b["sizes"], b["own"], b["n"], b["keys"]):
                own, df = _restored(own), np.concatenate([unpack(x)[0] for x in n])
                key = np.zeros(len(df), dtype=np.int64)
                key[df > 1] = np.concatenate([_restored(x) for x in keys])
                out, at = [], 0
                for i, n in zip(np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(sizes, dtype=np.int64).tolist()):
                    k = own[at:at + n]
                    d = df[k]
                    first = np.lexsort((k, d))[:prefix_length(n, similarity)]
                    found = np.unique(k[first[d[first] > 1]])
                    out.append((key[found], np.full(len(found), i), np.full(len(found), n)))
                    at += n
                yield {c: np.concatenate(x) for c, x in zip(("key", "id", "size"), zip(*out))}
    postings = in_arrow(blocks.drop("keys").join(counted, "block"), choose, "key long, id long, size long").withColumn("class", _class(similarity))
    # compatible sizes are in the same or the next class; one link to the smallest id keeps everybody who meets connected
    met = store(postings.select("key", "id", F.explode(F.array("class", F.col("class") + 1)).alias("class")), "prefixes")
    low = met.groupBy("key", "class").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").drop("z")
    return met.join(low, ["key", "class"]).filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _class(similarity: float):
    """Sizes within the similarity are at most one class apart; a little wider than the bound for rounding."""
    return F.floor(F.log(F.col("size").cast("double")) / (math.log(1 / similarity) + 1e-6))


def _grouped_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the similar sets within each group of rows (g, id, set); one group is held at a time."""
    def answer(ids, sets):
        label = linked(sets, similarity)
        moved = np.nonzero(label != np.arange(len(label)))[0]
        ids = np.array(ids, dtype=np.int64)
        return {"a": ids[label[moved]], "b": ids[moved]}

    def run(batches):
        held, ids, sets = None, [], []
        for b in batches:
            for g, i, s in zip(b["g"], b["id"], b["set"]):
                if g != held and len(ids) > 1:
                    yield answer(ids, sets)
                if g != held:
                    held, ids, sets = g, [], []
                ids.append(i)
                sets.append(np.frombuffer(s, dtype=np.int64))
        if len(ids) > 1:
            yield answer(ids, sets)
    return in_arrow(rows.select("g", "id", "set").repartition("g").sortWithinPartitions("g"), run, "a long, b long")


def similar_links(sets: DataFrame, clusters: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar sets (id, size, set) of each cluster (id, cluster).

    A small cluster is one group. In a crowded one all sets meet the one of smallest id first. Those near it
    are one group already and need not meet each other, but every other set meets them all, and all the
    other ones, a block against a block.
    """
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = store(clusters.join(n, "cluster"), "clusters")
    small = _grouped_links(placed.filter(F.col("n") <= CHUNK).select(F.col("cluster").alias("g"), "id").join(sets, "id"), similarity)
    crowded = placed.filter(F.col("n") > CHUNK).select("id", "cluster")
    if crowded.isEmpty():
        return small
    centres = sets.select(F.col("id").alias("cluster"), F.col("set").alias("centre")).join(crowded.select("cluster").distinct(), "cluster", "left_semi")

    def meet(batches):
        for b in batches:
            near = []
            for s, c in zip(b["set"], b["centre"]):
                x, y = np.frombuffer(s, dtype=np.int64), np.frombuffer(c, dtype=np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(int(shared >= similarity * (len(x) + len(y) - shared)))
            yield {"id": b["id"], "cluster": b["cluster"], "size": b["size"], "near": near}
    met = in_arrow(crowded.join(sets, "id").join(centres, "cluster").select("id", "cluster", "size", "set", "centre"), meet,
                   "id long, cluster long, size long, near long").withColumn("class", _class(similarity))
    met = store(met, "centres")
    stars = met.filter("near = 1 and id <> cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    block = ["cluster", "near", "class", "slot"]
    slots = cut_lineage(met.groupBy("cluster", "near", "class").agg(F.ceil(F.count("*") / CHUNK).alias("slots")))
    member = met.join(slots, block[:3]).select("id", *block[:3], F.pmod(F.xxhash64("id"), F.col("slots")).alias("slot"))
    blocks = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(
        "cluster", F.struct("near", "class", "slot").alias("p"))
    # both near the centre: linked already; sizes more than a class apart: too different
    pairs = blocks.join(blocks.withColumnRenamed("p", "q"), "cluster").filter(
        (F.col("p") <= F.col("q")) & (F.col("p.near") * F.col("q.near") == 0) & (F.abs(F.col("p.class") - F.col("q.class")) <= 1))
    dealt = pairs.select("cluster", F.xxhash64("cluster", "p", "q").alias("g"), F.explode(F.array_distinct(F.array("p", "q"))).alias("p")).select(
        "g", "cluster", "p.near", "p.class", "p.slot")
    blocked = _grouped_links(dealt.join(member, block).select("g", "id").join(sets, "id"), similarity)
    return small.unionByName(stars).unionByName(blocked)


def similar_groups(texts: DataFrame, total: int, width: int, similarity: float, seed: int, more: DataFrame) -> DataFrame:
    """Columns node, component (smallest id) of all texts (id, text) that have a similar one.

    ``more``: links (a, b) between further candidates; they are compared like those that share a prefix.
    """
    candidates = more.unionByName(meetings(texts, total, width, similarity, seed))
    clusters = cut_lineage(connected_components(candidates, "a", "b").select(
        F.col("node").alias("id"), F.col("component").alias("cluster")))

    def read(batches):
        hashes = WordHashes(seed)
        for b in batches:
            sets = [shingle_set(t, width, hashes) for t in b["text"]]
            yield {"id": b["id"], "size": [len(s) for s in sets], "set": [s.tobytes() for s in sets]}
    sets = store(in_arrow(texts.join(clusters, "id", "left_semi").dropDuplicates(["id"]), read, "id long, size long, set binary"), "shingles")
    return connected_components(similar_links(sets, clusters, similarity), "a", "b")
