"""Embedding near-duplicates in the cells of a spherical k-means.

Equal vectors become one class first. Centres are fitted on a bounded sample; every class belongs to
the cell of its nearest centre and is a guest in cells that are nearly as near, so links across a
border are found too. Inside a cell, blocks of vectors meet in matrix products; a cell larger than a
block is spread over one task per pair of blocks. Tasks return counts per vector and a spanning
forest of the links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import in_arrow, query, store, table
from .jaccard import forest

THRESHOLD, MARGIN, CELL, BLOCK, MOST_CELLS, SAMPLE, ROUNDS, TILE = 0.9, 0.15, 1000, 4096, 4096, 16_000, 8, 1024


def _unit(vector, size: int | None = None):
    """The vector divided by its length, or None if it links with nothing."""
    if vector is None or any(v is None for v in vector):
        return None
    x = np.asarray(vector, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    x = x / np.abs(x).max() if np.abs(x).max() > 0 else x  # no overflow or underflow of the squares
    length = np.sqrt(x @ x)
    return x / length if length > 0 and np.isfinite(length) else None


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns id, dim, unit (packed doubles, null if the vector links with nothing)."""
    def run(batches):
        for b in batches:
            units = [_unit(v) for v in b["v"]]
            yield {"id": b["id"], "dim": [0 if u is None else len(u) for u in units], "unit": [None if u is None else u.tobytes() for u in units]}
    return in_arrow(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), run, "id long, dim int, unit binary")


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: nearest centre by cosine, centres are normed means; empty cells keep their centre."""
    centres = sample[np.random.default_rng(11).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _links(left: np.ndarray, right: np.ndarray, threshold: float):
    """Index pairs with cosine at or above the threshold, tile by tile."""
    for a in range(0, len(left), TILE):
        for b in range(0, len(right), TILE):
            i, j = np.nonzero(left[a:a + TILE] @ right[b:b + TILE].T >= threshold)
            if len(i):
                yield i + a, j + b


def near_vectors(classes: DataFrame, dim: int, count: int, threshold: float, margin: float, cell_size: int, block: int) -> DataFrame:
    """Rows (a, b, n): with b null, n vectors are linked with class a; else a link of the spanning forest.

    classes: key, unit, n (vectors in the class), all of one dimension.
    """
    spark = classes.sparkSession
    cells = max(1, min(MOST_CELLS, math.ceil(count / cell_size)))
    picked = classes.orderBy(F.xxhash64("key"), "key").limit(max(SAMPLE, 4 * cells)).select("unit").collect()
    centres = fit_centres(np.frombuffer(b"".join(bytes(r["unit"]) for r in picked), dtype=np.float64).reshape(-1, dim), cells)

    def assign(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["unit"]), dtype=np.float64).reshape(-1, dim)
            for at in range(0, len(x), 2048):
                near = x[at:at + 2048] @ centres.T
                own = np.argmax(near, axis=1)
                rows, cell = np.nonzero((near >= near.max(axis=1, keepdims=True) - margin) | (np.arange(near.shape[1]) == own[:, None]))
                member = np.split(cell, np.cumsum(np.bincount(rows, minlength=len(near)))[:-1])
                s = slice(at, at + 2048)
                yield {"key": b["key"][s], "n": b["n"][s], "unit": b["unit"][s], "own": own, "cells": [m.tolist() for m in member]}

    placed = store(in_arrow(classes.select("key", "n", "unit"), assign, "key long, n long, unit binary, own int, cells array<int>"), "cells")
    spread = placed.withColumn("cell", F.explode("cells"))
    # one row per cell, at most MOST_CELLS of them
    sizes = spread.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = spread.join(F.broadcast(sizes), "cell").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tasks = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "key", "n", "unit", "own", "cells")
    schema = "a long, b long, n long"

    def compare(group: pa.Table) -> pa.Table:
        cell, lo, hi = (group[c][0].as_py() for c in ("cell", "lo", "hi"))
        key, n, own, mine = (group[c].to_numpy() for c in ("key", "n", "own", "mine"))
        member = group["cells"].to_pylist()
        x = np.frombuffer(b"".join(group["unit"].to_pylist()), dtype=np.float64).reshape(-1, dim)
        linked, label = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        host = own == cell

        def meet(p, q):
            """Vectors p, at home in this cell, against q."""
            nonlocal label
            for i, j in _links(x[p], x[q], threshold):
                i, j = p[i], q[j]
                # a pair of two residents counts once; one with a guest where it is found first
                guest = ~host[j]
                keep = guest | (key[i] < key[j]) if lo == hi else np.ones(len(i), dtype=bool)
                for at in np.nonzero(guest)[0].tolist():
                    keep[at] = cell < own[j[at]] or own[j[at]] not in member[i[at]]
                i, j = i[keep], j[keep]
                np.add.at(linked, i, n[j])
                np.add.at(linked, j, n[i])
                label = np.minimum(label, forest(len(label), np.r_[i, np.arange(len(label))], np.r_[j, label]))
        everyone = np.arange(len(key))
        if lo == hi:
            meet(everyone[host], everyone)
        else:
            first, second = everyone[mine == lo], everyone[mine == hi]
            meet(first[host[first]], second)
            meet(second[host[second]], first[~host[first]])
        label = forest(len(label), everyone, label)
        some, moved = np.nonzero(linked)[0], np.nonzero(label != everyone)[0]
        return pa.table({"a": np.r_[key[some], key[moved]], "b": pa.array([None] * len(some) + key[label[moved]].tolist(), type=pa.int64()),
                         "n": np.r_[linked[some], np.zeros(len(moved), dtype=np.int64)]})
    return tasks.groupBy("cell", "lo", "hi").applyInArrow(compare, schema)


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                         margin: float = MARGIN, cell_size: int = CELL, block: int = BLOCK) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept; one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths do not link with each other. Equal directions are one class, so a
    class of any size is one vector in the products. A null id names a component only if nothing else does. Extra
    columns are not read; an empty table gives an empty result. Links are those found in the cells:
    all are at or above the threshold; ``margin`` sets how far a vector is a guest beyond its cell.
    """
    rows = store(unit_vectors(vectors, id_col, vector_col), "units")
    classes = store(rows.filter("unit is not null").groupBy("dim", "unit").agg(
        F.min("id").alias("low"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "classes")
    found = None
    # one pass per vector length; embeddings of one table have one, as a rule
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        part = near_vectors(classes.filter(F.col("dim") == r["dim"]), r["dim"], r["n"], threshold, margin, cell_size, block)
        found = part if found is None else found.unionByName(part)
    single = rows.filter("unit is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                                                F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return single
    found = store(found, "links")
    joined = connected_components(found.filter("b is not null"), "a", "b").select(F.col("node").alias("key"), "component")
    links = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
    named = classes.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    verdict = cut_lineage(named.join(lowest, "component").join(links, "key", "left").select(
        "dim", "unit", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    return rows.filter("unit is not null").join(verdict, ["dim", "unit"]).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")).unionByName(single)


@query("op6_embedding_near_dedup")
def op6(spark, sf_dir):
    return embedding_components(table(spark, sf_dir, "embeddings"))
