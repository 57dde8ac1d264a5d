"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Session for tests and the local bench; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hearthgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster such a folder
    would vanish with its machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="hearthgrid-")
    sc.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that Spark writes and reads back."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps the plan of loops short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def never_sent(df: DataFrame) -> DataFrame:
    """One side of an equi-join that grows with the input: both sides are shuffled, none is broadcast.

    Spark's estimates know neither how many rows ``explode`` adds nor how far files are compressed, so a
    table of many millions of rows may look small enough to be collected by the driver.
    """
    return df.hint("merge")


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores before heavy per-row work.

    Large inputs already have more splits and pass unchanged. Only for plain scans: counting the
    splits of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that Python workers can import it.

    On a cluster the executors' machines hold no copy of the repository; Spark distributes the archive.
    """
    sc = spark.sparkContext
    if getattr(sc, "_hearthgrid_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="hearthgrid-"), "hearthgrid.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._hearthgrid_shipped = True


def ship_active() -> None:
    """``ship_package`` for functions that only see columns: the session that is active here."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
