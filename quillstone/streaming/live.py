"""Streaming jobs over build events: live state, quarantine, log upsert, timeouts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir
from . import events as E


FACTS = "build long, field string, value string, ord long"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"


# --- state folder: numbered snapshots and the changes after them ---------------------------------

COMPACT_EVERY = 16


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbered(spark: SparkSession, folder: str, mark: str, finished: bool) -> list[int]:
    """Numbers n of the sub-folders ``mark=n``, in order; with ``finished`` only those that were written to the end."""
    fs, place = _fs(spark, folder)
    if not fs.exists(place):
        return []
    found = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(f"{mark}=") and (not finished or fs.exists(_fs(spark, f"{folder}/{name}/_SUCCESS")[1])):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def live_state(spark: SparkSession, root: str) -> DataFrame:
    """Current facts of a state folder: the newest whole snapshot and what changed after it."""
    changes = spark.read.schema(FACTS + ", b long").parquet(f"{root}/changes")
    snapshots = _numbered(spark, f"{root}/snapshots", "s", True)
    if not snapshots:
        return E.current(changes.drop("b"))
    newest = snapshots[-1]
    snapshot = spark.read.schema(FACTS).parquet(f"{root}/snapshots/s={newest}")
    return E.current(snapshot.unionByName(changes.filter(F.col("b") > newest).drop("b")))


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Write the state up to micro-batch ``upto`` as a snapshot, then remove what the one before it covers.

    A snapshot counts once its success marker stands, so a run that is lost before that leaves
    the old snapshot and its changes in force, and one that is lost after it leaves only more
    files than needed: facts read twice are the same facts.  Readers that began on the snapshot
    before keep their files, since these go one generation later.
    """
    before = [n for n in _numbered(spark, f"{root}/snapshots", "s", True) if n < upto]
    live_state(spark, root).select("build", "field", "value", "ord").write.mode("overwrite").parquet(f"{root}/snapshots/s={upto}")
    if before:
        covered = before[-1]
        old = [f"snapshots/s={n}" for n in _numbered(spark, f"{root}/snapshots", "s", False) if n < covered]
        old += [f"changes/b={n}" for n in _numbered(spark, f"{root}/changes", "b", False) if 0 <= n <= covered]
        for name in old:
            fs, place = _fs(spark, f"{root}/{name}")
            fs.delete(place, True)


def run_live_state(stream: DataFrame, build: str, ord_: str, root: str | None = None, every: int = COMPACT_EVERY) -> DataFrame:
    """Drain ``stream`` of parsed events into the state folder ``root``; returns the state.

    A micro-batch writes the facts it changed under its own number, so its work follows the
    batch and not the state, and a repeated batch rewrites the same rows.  After ``every`` of
    them the state becomes a snapshot, so the folder holds a bounded number of changes however
    long the stream runs.  Progress is kept in
    ``root`` too: a later run over the same source goes on where this one stopped.  Without
    ``root`` a new folder is taken.  Lines that are no JSON go to a quarantine table.
    """
    spark = stream.sparkSession
    root = root or _folder(spark, "state")
    spark.createDataFrame([], FACTS).write.mode("ignore").parquet(f"{root}/changes/b=-1")  # a stream may be empty

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.filter(~F.col("is_json")).select(ord_, "message").write.mode("overwrite").parquet(f"{root}/quarantine/b={batch_id}")
        E.current(E.facts(batch, build, ord_)).select("build", "field", "value", "ord").write.mode("overwrite").parquet(
            f"{root}/changes/b={batch_id}")
        if batch_id % every == every - 1:
            compact(spark, root, batch_id)

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return live_state(spark, root)


def run_log_tail(stream: DataFrame, ord_: str, ts: str, within: str = "10 minutes", root: str | None = None) -> DataFrame:
    """Append log rows once per event id; the watermark bounds the state of seen ids.

    Rows, seen ids and progress stay in ``root``, so a later run goes on from there.
    """
    spark = stream.sparkSession
    root = root or _folder(spark, "logs")
    once = stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([ord_])
    spark.createDataFrame([], once.schema).write.mode("ignore").parquet(f"{root}/data")  # the sink's own log hides this file
    query = (
        once.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{root}/data")


SUMS = "build long, last_ord long, events long, completed boolean"
STATE = "last_ord long, events long, completed boolean"
OUT = "build long, last_ord long, events long, status string"
SILENCE_MS = 3_600_000


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per build of what a task has read, so that few rows reach the state."""
    for f in frames:
        yield f.groupby("build", as_index=False).agg(last_ord=("ord", "max"), events=("ord", "size"), completed=("completed", "any"))


def reduce_build(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Liveness of a build: latest event, event count, completion; failed after a silence without completion."""
    last, n, completed = state.get if state.exists else (-1, 0, False)
    if state.hasTimedOut:
        state.remove()
        status = "completed" if completed else "failed"
    else:
        for f in frames:
            last, n, completed = max(last, int(f["last_ord"].max())), n + int(f["events"].sum()), completed or bool(f["completed"].any())
        state.update((last, n, completed))
        state.setTimeoutDuration(SILENCE_MS)
        status = "completed" if completed else "running"
    yield pd.DataFrame([(*key, last, n, status)], columns=["build", "last_ord", "events", "status"])


def liveness(stream: DataFrame, build: str, ord_: str) -> DataFrame:
    """Stateful reducer keyed by build, fed with one row per build and task."""
    slim = stream.select(
        F.col(build).alias("build"), F.col(ord_).alias("ord"),
        F.coalesce((F.col("event") == "complete") & (F.col("status") == "completed"), F.lit(False)).alias("completed"))
    return slim.mapInPandas(_combine, SUMS).groupBy("build").applyInPandasWithState(
        reduce_build, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_liveness(stream: DataFrame, build: str, ord_: str, root: str | None = None) -> DataFrame:
    """Drain ``stream``; latest (build, last_ord, events, status).  State and progress stay in ``root``."""
    spark = stream.sparkSession
    root = root or _folder(spark, "liveness")
    spark.createDataFrame([], OUT).write.mode("ignore").parquet(f"{root}/data/b=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/b={batch_id}")

    # A processing-time timeout keeps asking for empty batches; a drain has to stop instead.
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    query = (
        liveness(stream, build, ord_).writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    spark.conf.set(setting, before)
    query.awaitTermination()
    rows = spark.read.schema(OUT + ", b int").parquet(f"{root}/data")
    last = rows.groupBy("build").agg(F.max_by(F.struct("last_ord", "events", "status"), "b").alias("s"))
    return last.select("build", "s.*")
