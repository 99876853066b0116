"""Runs that go on where an earlier one stopped, empty streams, silence."""

import shutil
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.plans import stream_plans as S
from quillstone.session import shared_dir
from quillstone.streaming import events as E, live

SF = "/root/testdata/sf0.001"


@pytest.fixture
def halves(spark, tmp_path):
    """A folder that a stream reads, and the two halves of ``events`` to put there."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    parts = []
    for i, part in enumerate((events.filter(F.col("event_id") <= middle), events.filter(F.col("event_id") > middle))):
        part.coalesce(1).write.parquet(f"{tmp_path}/half{i}")
        parts.append(next((tmp_path / f"half{i}").glob("part-*.parquet")))
    source = tmp_path / "source"
    source.mkdir()
    raw = spark.readStream.schema(events.schema).parquet(str(source))
    return source, parts, E.parse(S._with_lines(raw), "line")


def rows(df):
    return sorted(map(str, df.collect()))


def test_state_and_liveness_resume(spark, halves):
    source, parts, stream = halves
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    runs = {
        "state": lambda: live.run_live_state(stream, "user_id", "event_id", f"{root}/state"),
        "liveness": lambda: live.run_liveness(stream, "user_id", "event_id", f"{root}/liveness"),
    }
    assert all(run().count() == 0 for run in runs.values())  # nothing has arrived yet
    for i, part in enumerate(parts):
        shutil.copy(part, source / f"{i}.parquet")
        got = {name: run() for name, run in runs.items()}
    parsed = S._parsed(spark, SF)
    assert rows(E.phase_states(got["state"])) == rows(E.phase_states(S._state(spark, SF)))
    done = F.coalesce((F.col("event") == "complete") & (F.col("status") == "completed"), F.lit(False))
    want = parsed.groupBy(F.col("user_id").alias("build")).agg(
        F.max("event_id").alias("last_ord"), F.count("*").alias("events"), F.when(F.bool_or(done), "completed").otherwise("running").alias("status"))
    assert rows(got["liveness"]) == rows(want)
    assert rows(runs["liveness"]()) == rows(want)  # nothing new changes nothing


def test_snapshots_bound_the_state_folder(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = f"{tmp_path}/source"
    events.repartition(24, "event_id").write.parquet(source)  # a micro-batch per file
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    stream = E.parse(S._with_lines(raw), "line")
    want = rows(S._state(spark, SF).select("build", "field", "value", "ord"))

    def state():
        return rows(live.live_state(spark, root).select("build", "field", "value", "ord"))

    live.run_live_state(stream, "user_id", "event_id", root, every=4)
    assert state() == want
    done = live._numbered(spark, f"{root}/snapshots", "s", True)
    kept = live._numbered(spark, f"{root}/changes", "b", False)
    assert len(done) == 2 and len(kept) <= 10 and kept[0] == -1 and kept[1] == done[0] + 1

    # lost between writing a snapshot and its marker: the one before it and its changes still hold
    fs, marker = live._fs(spark, f"{root}/snapshots/s={done[-1]}/_SUCCESS")
    fs.delete(marker, False)
    assert live._numbered(spark, f"{root}/snapshots", "s", True) == done[:1] and state() == want
    # lost between the marker and the clean-up: facts read twice are the same facts
    live.compact(spark, root, kept[-1])
    monkeypatch.setattr(live, "_numbered", lambda *a, numbered=live._numbered: [] if a[1].endswith("changes") else numbered(*a))
    live.compact(spark, root, kept[-1] + 1)
    assert state() == want


def test_log_tail_resumes_without_repeating(spark, halves):
    source, parts, stream = halves
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    log = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    assert live.run_log_tail(log, "event_id", "ts", "100 days", root).count() == 0
    shutil.copy(parts[0], source / "a.parquet")
    live.run_log_tail(log, "event_id", "ts", "100 days", root)
    for name in "bc":  # the first half comes again with the second one
        shutil.copy(parts[0 if name == "b" else 1], source / f"{name}.parquet")
    ids = [r.event_id for r in live.run_log_tail(log, "event_id", "ts", "100 days", root).collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/events.parquet").count()


class State:
    def __init__(self, value=None, timed_out=False):
        self.get, self.hasTimedOut, self.removed, self.timeout = value, timed_out, False, None

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value

    def remove(self):
        self.get, self.removed = None, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


@pytest.mark.parametrize("completed, status", [(False, "failed"), (True, "completed")])
def test_silence_ends_a_build(completed, status):
    state = State((9, 4, completed), timed_out=True)
    (out,) = live.reduce_build((7,), iter(()), state)
    assert out.to_dict("records") == [{"build": 7, "last_ord": 9, "events": 4, "status": status}] and state.removed


def test_events_move_the_timeout_on():
    state = State()
    frame = pd.DataFrame({"last_ord": [3, 8], "events": [2, 5], "completed": [False, False]})
    (out,) = live.reduce_build((7,), iter([frame]), state)
    assert out.status.tolist() == ["running"] and state.get == (8, 7, False) and state.timeout == live.SILENCE_MS
