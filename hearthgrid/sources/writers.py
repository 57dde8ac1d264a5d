"""Sinks: partition replacement, audit rows, long time series and text exports."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T


def begin_changelog(spark: SparkSession, tool: str, comment: str = "no comment", modified_by: str | None = None,
                    ags: str | None = None, process_id: int | None = None) -> DataFrame:
    """One audit row. The id is a hash of its content and time, so no counter is shared.

    The time is taken once here: the row that is written and the id on the data rows agree.
    """
    user = F.lit(modified_by) if modified_by else F.current_user()
    now = F.lit(datetime.now(timezone.utc))
    return spark.range(1).select(
        F.lit(tool).alias("tool"), now.alias("modified_at"), F.lit(comment).alias("comment"),
        user.alias("modified_by"), F.lit(ags).cast("string").alias("ags"),
        F.lit(process_id if process_id is not None else os.getpid()).cast("bigint").alias("process_id")
    ).select(changelog_id("tool", "ags", "modified_at").alias("id"), "*")


def changelog_id(tool, ags, at) -> Column:
    return F.xxhash64(tool, F.coalesce(F.col(ags) if isinstance(ags, str) else ags, F.lit("")), F.col(at).cast("string") if isinstance(at, str) else at.cast("string"))


def stamp(df: DataFrame, entry: DataFrame) -> DataFrame:
    """Write the id of an audit row (one row by construction) on every row."""
    return df.withColumn("changelog_id", F.lit(entry.first()["id"]))


def write_partition(df: DataFrame, path: str, key: str | list[str], rows_per_file: int = 5_000_000) -> None:
    """Replace the partitions that ``df`` holds; others stay.

    The rows are rebalanced by key: adaptive execution joins small keys and splits large ones by size,
    so that no key passes a single task; ``rows_per_file`` bounds the files.
    """
    keys = [key] if isinstance(key, str) else key
    (df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path))


def timeseries_long(wide: DataFrame, meta: DataFrame, columns: dict[str, str], owner: str = "objectid") -> DataFrame:
    """Wide series columns (name -> column) to rows (ts_metadata_id, time, value) without null times."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in columns.items()])
    long = wide.filter(F.col("time").isNotNull()).select(owner, "time", F.explode(pairs).alias("s")).select(owner, "time", "s.*")
    ids = meta.select(F.col("id").alias("ts_metadata_id"), "name", F.col("grid_id").alias(owner))
    return long.join(ids, ["name", owner]).select("ts_metadata_id", "time", "value")


def write_timeseries(long: DataFrame, path: str) -> None:
    """Fact table partitioned by month, rebalanced by size, and sorted by series inside the files."""
    part = long.withColumn("month", F.date_format("time", "yyyy-MM"))
    (part.hint("rebalance", "month").sortWithinPartitions("month", "ts_metadata_id", "time")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def export_frame(df: DataFrame) -> DataFrame:
    """Geometry columns named geom, the_geom or geometry as WKT, others as they are."""
    out = []
    for f in df.schema.fields:
        kind = T.kind_of(f.dataType.simpleString())
        if f.name.lower() in ("geom", "the_geom", "geometry") and kind:
            out.append(T.to_wkt(f.name, kind).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def export_table(df: DataFrame, path: str) -> None:
    export_frame(df).write.mode("overwrite").csv(path, header=True, escape='"')


def run_steps(frame: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame] | str]], **params) -> DataFrame:
    """Named steps in name order: functions on the frame, or SQL over the view ``input``.

    SQL texts take ``{name}`` parameters; empty texts are skipped.
    """
    spark = frame.sparkSession
    for name, step in sorted(steps, key=lambda s: s[0]):
        if callable(step):
            frame = step(frame)
        elif step.strip():
            frame = spark.sql(step, args={k: v for k, v in params.items()}, input=frame)
    return frame


def run_sql_folder(spark: SparkSession, folder: str, frame: DataFrame, **params) -> DataFrame:
    """The ``.sql`` files of a folder as steps over ``{input}``, in file name order."""
    files = sorted(f for f in os.listdir(folder) if f.endswith(".sql"))
    steps = []
    for f in files:
        with open(os.path.join(folder, f), encoding="utf-8") as handle:
            steps.append((f, handle.read()))
    return run_steps(frame, steps, **params)
