"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the input of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthgrid.llm.bpe import decode_documents, encode_documents
from hearthgrid.llm.common import prepare, store, table
from hearthgrid.llm.decontamination import drop_contaminated
from hearthgrid.llm.simhash import drop_near_duplicates
from hearthgrid.llm.substring_dedup import without_repeats
from hearthgrid.llm.toxicity import drop_toxic
from hearthgrid.llm.wordpieces import public_path

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not reject."""
    prepare(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash and prefix candidates, five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that start earlier in the corpus; all documents stay."""
    prepare(spark)
    return without_repeats(docs, size_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the decoded text."""
    prepare(spark)
    file = public_path(TOKENIZER)
    return decode_documents(encode_documents(docs, file), file).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", decontamination), ("bpe_encode_decode", tokens)]

# a learnt grammar, similarity groups and merges have no SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
