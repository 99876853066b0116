"""Session helpers: local sessions for tests, shared folder for materialised tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quillstone", cpus: str | int = "*", memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster job passes its own session instead."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its node, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process, so one file system
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, label: str, spread: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage without tying the data to an executor, and gives the
    optimizer real sizes for the joins that follow.  ``spread`` is for rows
    that carry whole texts: a result too small to fill the cores is dealt out
    again, a large one keeps its own splits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return back.repartition(cores) if spread and back.rdd.getNumPartitions() < cores else back
