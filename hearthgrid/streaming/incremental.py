"""Series files that keep arriving: the batch loader inside ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import load_timeseries
from ..sources.writers import write_partition

SCHEMA = "grid_id string, longitude double, latitude double, start timestamp, step_seconds long, hourly map<string,array<double>>"


def upsert_days(spark: SparkSession, facts: DataFrame, path: str) -> None:
    """Merge facts by (series, time) into a table partitioned by day, rewriting only touched days."""
    from ..operators.tables import upsert
    from ..session import cut_lineage

    new = facts.groupBy("ts_metadata_id", "time").agg(F.max("value").alias("value")).withColumn("day", F.to_date("time"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        days = new.select("day").distinct()
        old = spark.read.parquet(path).join(days, "day", "left_semi").select(*new.columns)
        new = upsert(old, new, ["ts_metadata_id", "time"])
        # the table is read and replaced in one job: fix the rows first
        new = cut_lineage(new)
    write_partition(new, path, "day")


def stream_timeseries(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Load new JSON files once each; a batch that is repeated after a failure changes nothing."""
    raw = spark.readStream.schema(SCHEMA).json(source)

    def load(batch: DataFrame, _: int) -> None:
        rows = batch.select("grid_id", "longitude", "latitude", "start", "step_seconds", F.explode("hourly").alias("variable", "values"))
        upsert_days(batch.sparkSession, load_timeseries(rows)[1], target)

    return raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
