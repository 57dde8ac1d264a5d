"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds, per bit, the majority of the 64-bit hashes of all word shingles of a text. To
find every pair of fingerprints that differ in at most r bits, each bit position i gets a non-zero
vector p(i) of r + 1 bits, and each non-zero vector v of r + 1 bits gives one table whose mask keeps
the positions with odd <p(i), v>. For any r differing positions some v is orthogonal to all of their
vectors, so the two fingerprints agree under that mask: every pair within the radius meets in at
least one of the 2^(r+1) - 1 tables.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage, never_sent
from .common import WordHashes, in_arrow, key_and_bytes, query, store, table
from .jaccard import forest, shingle_set, similar_groups

SHINGLE, RADIUS, SEED = 3, 2, 42


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks over 64 bits.

    Positions take the non-zero vectors in turn, or the upper half of them if there are more than 64
    positions can take: either way each mask keeps about half of the positions or more.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be from 0 to 6")
    top = 2 ** (radius + 1)
    vectors = [1 + i % (top - 1) if top <= 64 else top // 2 + i % (top // 2) for i in range(64)]
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() % 2) for v in range(1, top)]


def shingle_bytes(text: bytes, width: int) -> list[bytes]:
    """All word shingles, repeats included, words joined by one space; A-Z are lowered first."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return [whole[a:b] for a, b in zip(starts[:len(words) - width + 1].tolist(), (ends[width - 1:] - 1).tolist())]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits over all shingle hashes; 0 for a text without words."""
    parts = shingle_bytes(text, width)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(parts), 65536):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts[at:at + 65536]]), dtype=np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """Columns id, fp (64 bits as a signed long), one row per input row."""
    def run(batches):
        for b in batches:
            yield {"id": b["id"], "fp": np.array([fingerprint(t, width, seed) for t in b["text"]],
                                                 dtype=np.uint64).astype(np.int64)}
    return in_arrow(key_and_bytes(docs, id_col, text_col), run, "id long, fp long")


def _near(values: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most ``radius`` bits apart among sorted distinct values that agree outside ``free``.

    Few values are compared directly; many are probed with every change of at most ``radius`` free
    bits, as long as there are fewer changes than values. Both find the same pairs.
    """
    n = len(values)
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    probes = sum(_choose(len(bits), k) for k in range(1, radius + 1))
    if n <= probes:
        for_a, for_b = [], []
        step = max(1, 4_000_000 // n)
        for at in range(0, n, step):
            a, b = np.nonzero(np.bitwise_count(values[at:at + step, None] ^ values[None, :]) <= radius)
            keep = a + at < b
            for_a.append(a[keep] + at)
            for_b.append(b[keep])
        return np.concatenate(for_a), np.concatenate(for_b)
    for_a, for_b = [], []
    changes = [np.uint64(0)]
    seen = set()
    for _ in range(radius):
        changes = [c ^ b for c in changes for b in bits]
        for c in changes:
            if c in seen or not c:
                continue
            seen.add(c)
            other = values ^ c
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.nonzero((values[at] == other) & (values < other))[0]
            for_a.append(hit)
            for_b.append(at[hit])
    return np.concatenate(for_a), np.concatenate(for_b)


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def _meetings(rows: DataFrame, radius: int, links, schema: str) -> DataFrame:
    """Deal rows (fp, further long columns) out to every table, and call ``links(mask, columns)`` on the rows
    that agree under a mask. Values go in their sorted order through a task; only one is held at a time."""
    masks = covering_masks(radius)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    names = ["t", "key", *rows.columns]
    dealt = rows.withColumn("e", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))).select(
        F.col("e.t").alias("t"), F.col("e.key").alias("key"), *rows.columns)

    def groups(columns):
        t, key = columns[:2]
        edge = np.nonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))[0] + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(t)]
        some = ends - starts > 1
        found = [links(masks[t[s]], [c[s:e] for c in columns[2:]]) for s, e in zip(starts[some].tolist(), ends[some].tolist())]
        if found := [f for f in found if f is not None]:
            yield {c: np.concatenate([f[c] for f in found]) for c in found[0]}

    def run(batches):
        held = None
        for b in batches:
            now = [np.array(b[c], dtype=np.int64) for c in names]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            last = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0  # the last value may go on in the next batch
            if cut:
                yield from groups([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from groups(held)
    return in_arrow(dealt.repartition("t", "key").sortWithinPartitions("t", "key"), run, schema)


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep every component within the radius.

    Every table is dealt out by its masked value. Inside one value all links within the radius are
    found, and a spanning forest of them is returned, so a crowded value gives no more rows than it
    has fingerprints.
    """
    def links(mask, columns):
        values = np.sort(columns[0].view(np.uint64))
        label = forest(len(values), *_near(values, ~mask & (2**64 - 1), radius))
        moved = np.nonzero(label != np.arange(len(label)))[0]
        return {"a": values[moved].view(np.int64), "b": values[label[moved]].view(np.int64)} if len(moved) else None
    return _meetings(distinct.select("fp"), radius, links, "a long, b long")


def fingerprint_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all rows (id, fp) whose fingerprints differ in at most ``radius`` bits."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    same = rows.join(never_sent(classes), "fp").filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    ends = [classes.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in "ab"]
    near = near_fingerprints(classes.select("fp"), radius).join(never_sent(ends[0]), "a").join(never_sent(ends[1]), "b").select(
        F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    return same.unionByName(near)


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
                         text_col: str = "text", seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` without near-duplicates, all columns kept: of every group the row of the smallest id stays.

    A pair is a duplicate if the sets of ``width``-word shingles (A-Z lowered) have a Jaccard similarity of
    at least ``similarity``; every such pair counts, and groups are what the pairs connect. Candidates are the
    texts whose SimHash fingerprints differ in at most ``radius`` bits; those further apart in SimHash are
    found by a prefix filter, and all are compared exactly. Texts of equal shingles are duplicates. Null texts count as empty, and only one empty text stays; a null id counts as
    the smallest. An empty table stays empty.
    """
    kid, th = F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)), F.xxhash64(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    keyed = docs.select(kid.alias("kid"), th.alias("th"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))

    def read(batches):
        hashes = WordHashes(seed)
        for b in batches:
            sets = [shingle_set(t, width, hashes) for t in b["text"]]
            yield {"kid": b["kid"], "th": b["th"], "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets],
                   "fp": np.array([fingerprint(t, SHINGLE, seed) for t in b["text"]], dtype=np.uint64).astype(np.int64)}

    # one row per document: ids of rows are replaced by a dense key, so repeated ids are told apart
    rows = store(in_arrow(keyed, read, "kid long, th long, same binary, size long, fp long").dropDuplicates(["kid", "th"]), "word-sets")
    first = rows.groupBy("same").agg(F.min_by(F.struct("kid", "th", "size", "fp"), F.struct("kid", "th")).alias("r")).select("r.*")
    # ascending in (kid, th), and the same in every run over the same rows
    rest = store(first.repartitionByRange("kid", "th").sortWithinPartitions("kid", "th").withColumn("id", F.monotonically_increasing_id()), "distinct")
    total = rest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    texts = keyed.join(rest, ["kid", "th"]).select("id", "text")
    # every component keeps its smallest id
    labels = similar_groups(texts, total, width, similarity, seed, fingerprint_links(rest.select("id", "fp"), radius)).filter("node <> component").select(F.col("node").alias("id"))
    kept = cut_lineage(rest.join(labels, "id", "left_anti").select(F.col("kid").alias("__kid"), F.col("th").alias("__th")))
    # the row travels in a struct: columns of any name come back as they were
    whole = docs.select(kid.alias("__kid"), th.alias("__th"), F.struct(*docs.columns).alias("__row"))
    return whole.join(kept, ["__kid", "__th"], "left_semi").dropDuplicates(["__kid", "__th"]).select("__row.*")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                       radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Columns id, fp, component_id (smallest id reachable over fingerprints within the radius).

    One row per input row, also for repeated ids. Null and empty texts have fingerprint 0 and link
    like any other. A null id keeps its row and never names a component that has another id. An
    empty table gives an empty result. Only the id and text columns are read.

    Equal fingerprints are one node, so a group of copies of any size costs one row in the tables.
    """
    rows = store(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    joined = connected_components(near_fingerprints(classes.select("fp"), radius), "a", "b").select(
        F.col("node").alias("fp"), "component")
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    # stored, so that the join below meets a plain table and a crowded fingerprint can be split
    names = cut_lineage(named.join(lowest, "component").select("fp", "component_id"))
    return rows.join(names, "fp")


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
