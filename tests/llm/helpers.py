"""Small documents with the awkward cases every operator must take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("kid", T.StringType()), T.StructField("t", T.StringType())])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(30, 160))) for _ in range(n)]
    passage = " ".join(words(rng, 45))
    for k in range(5, n, 6):
        texts[k] = texts[k] + "\n" + passage + " " + texts[k - 1][:40]
    texts[7] = texts[3]
    texts[9] = texts[3].replace(texts[3].split()[10], "other", 1)
    texts[11] = " ".join(words(rng, 4000, 50))
    texts += ["", None, "one", "one two", " \t\n ", "ab " * 200, "ab " * 150, "x" * 300, "x" * 260, "é ü 漢字 Σ " * 30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)
