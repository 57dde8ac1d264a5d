"""Line dedup over range-partitioned line hashes, with keep bitmaps per document; built-in functions only.

Every line is a row (two 64-bit hashes of its key, document, position). The rows are range-partitioned
and sorted by (hash, document, position): a line that fills a third of the corpus spreads over many
ranges, because the document is part of the range key. The sorted stream shows the first occurrence of a
key in each document; partial sums over these give the number of documents per key. Verdicts go back to
the lines, and each document gets a run-length bitmap of the lines it keeps. Texts are not part of
any of this; ``apply_bitmaps`` cuts them afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, store, table

LEAST_DOCS, LEAST_CHARS, RANGE_ROWS, HEAVY = 10, 1, 2_000_000, 512
_SPACE = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc, version (of the text, should rows repeat a doc id), text; null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("version", F.xxhash64("text"))


def line_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Columns doc, version, pos (from 0), h1, h2 of every line whose key has ``least_chars`` code points."""
    lines = _keyed(docs, id_col, text_col).select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    return keys.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
                  least_chars: int = LEAST_CHARS, keep_first: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Columns doc, version, pos: the lines to drop.

    A line goes if its key occurs in ``least_docs`` documents or more. With ``keep_first`` the first
    occurrence (smallest document, then position, then hash of the text) stays. Rows that repeat a doc id count as one
    document, null ids too; equal rows get the same verdicts. Keys meet by 128 hash bits.
    """
    lines = store(line_positions(docs, id_col, text_col, least_chars), "lines")
    total = lines.count()
    # the sort of a range serves the first sum as it stands; the second gets one partial row per key and range
    ranged = lines.repartitionByRange(max(1, -(-total // range_rows)), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "pos", "version")
    seen = ranged.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    repeated = store(seen.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min("place").alias("first")).filter(
        F.col("docs") >= least_docs), "repeated-lines")
    # a key with more than 1/HEAVY of all lines: fewer than HEAVY such keys exist, so they can be broadcast
    bound = max(1, total // HEAVY)
    heavy, light = repeated.filter(F.col("n") > bound), repeated.filter(F.col("n") <= bound)
    hot = lines.join(F.broadcast(heavy), ["h1", "h2"])
    rest = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti").join(light, ["h1", "h2"])
    dropped = hot.unionByName(rest)
    if keep_first:
        dropped = dropped.filter(~place.eqNullSafe(F.col("first")))
    return dropped.select("doc", "version", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Columns doc, version, gone (dropped lines), runs: array of (start, size), the maximal runs of dropped lines.

    The runs are the document's keep bitmap in run-length code. Documents without dropped lines have no row.
    """
    at = dropped.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # a run starts where the position less its rank changes
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    return at.select("doc", "version", F.size("at").cast("long").alias("gone"), F.zip_with(
        starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size"))).alias("runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc, n_lines, n_dropped, kept (text of the other lines): one row for each row of ``docs``."""
    marks = bitmaps.select(F.col("doc").alias("of"), F.col("version").alias("v"), "gone", "runs")
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(marks, rows["doc"].eqNullSafe(marks["of"]) & (rows["version"] == marks["v"]), "left")
    lines = F.split("text", "\n", -1)
    # kept stretches lie before each dropped run and behind the last one
    after = F.transform("runs", lambda r: r["start"] + r["size"])
    begin = F.concat(F.array(F.lit(0)), after)
    end = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("lines", a + 1, b - a)))
    return joined.withColumn("lines", F.when(F.col("runs").isNotNull(), lines)).select(
        "doc", F.when(F.col("runs").isNotNull(), F.size("lines")).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
                      least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """Columns doc, n_lines, n_dropped, kept; one row per input row.

    Lines are what ``\\n`` separates; a null or empty text has one empty line. Empty keys (blank lines) are
    below ``least_chars`` and stay. An empty table gives an empty result. Only the id and text
    columns are read, so others may have any name.
    """
    return apply_bitmaps(docs, keep_bitmaps(line_verdicts(docs, id_col, text_col, least_docs, least_chars, keep_first)), id_col, text_col)


@query("op12_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
keyed AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key
           HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10),
judged AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
""")
def op12(spark, sf_dir):
    return drop_common_lines(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
