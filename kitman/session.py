"""Spark session helpers."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "kitman", driver_memory: str = "16g") -> SparkSession:
    """Session for tests/bench on one machine.  On a cluster, build the session
    with the cluster's own settings and use the library functions directly."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="kitman-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset in local
    mode (tests) point it at a fresh scratch folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not spark.sparkContext.getCheckpointDir() and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        current = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="kitman-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def spread(df, per_core: int = 2):
    """Give a small but CPU-heavy input (few large rows) enough partitions
    to use every core.  Inputs already split wider than the cluster are left
    as they are (no shuffle)."""
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df, label: str):
    """``df`` written to the shared folder and read back: what several branches of a
    query use is computed once, and a lost executor costs no more than its own files."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
