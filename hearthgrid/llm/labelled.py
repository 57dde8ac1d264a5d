"""Labelled samples of a bounded size and held-out scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import crc32_of, key_and_bytes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, text, y: at most ``per_class`` labelled training texts of each class.

    The ids come from the label table alone, in the order of a hash, so the sample has a fixed size
    bound and can be broadcast to the texts. Null labels and null ids are left out; an id with
    several labels counts as 1 if any of them is 1.
    """
    known = labels.filter(train & F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return key_and_bytes(docs, id_col, text_col).join(F.broadcast(picked), "id")


def training_rows(modulus: int, held_out: int, id_col: str = "doc_id") -> Column:
    return crc32_of(F.col(id_col)) % modulus != held_out


def with_verdict(scored: DataFrame, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of rows id, score."""
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(crc32_of(F.col("id")) % modulus == held_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
