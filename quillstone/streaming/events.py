"""Build events: parsing, latest facts, and the state views over them.

Every event is turned into facts (build, field, ord, value); state is the
latest fact per (build, field).  Taking the latest is commutative and
idempotent, so batches, micro-batches, replays and late rows share one code
path, and a build with a large share of the events combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ranking import ranked

EVENT = (
    "event string, phase string, name string, status string, level string, message string, progress double, score double, "
    "quality_score double, final_score double, atoms_extracted double, atoms_deduplicated double, atoms_verified double, "
    "compression_ratio double, api_cost_usd double, tokens_used double, count int"
)
METRICS = ("quality_score", "atoms_extracted", "atoms_deduplicated", "atoms_verified", "compression_ratio")
PHASES = 7


def parse(lines: DataFrame, line: str) -> DataFrame:
    """Typed event per line with defaults; ``is_json`` is false for lines to quarantine."""
    body = F.from_json(line, EVENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    e = lines.withColumn("_e", body)
    ok = F.col("_e").isNotNull() & F.col("_e._bad").isNull()
    fields = [c.split()[0] for c in EVENT.split(", ")]
    plain = [f for f in fields if f not in ("event", "level", "message")]
    return e.select(
        *lines.columns,
        ok.alias("is_json"),
        F.coalesce(F.when(ok, F.col("_e.event")), F.lit("log")).alias("event"),
        F.coalesce(F.when(ok, F.col("_e.level")), F.lit("info")).alias("level"),
        F.coalesce(F.when(ok, F.col("_e.message")), F.col(line)).alias("message"),
        *[F.when(ok, F.col(f"_e.{f}")).alias(f) for f in plain],
    )


def _truthy(c: str) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(False))


def facts(events: DataFrame, build: str, ord_: str) -> DataFrame:
    """(build, field, ord, value) rows of parsed events; value is text."""
    event = F.col("event")
    known = F.col("phase").rlike("^p[0-6]$")
    status = F.when(F.col("status") == "done", "done").otherwise("running")  # a failed phase may still report
    progress = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce("progress", F.lit(0.0))))).cast("string")

    def fact(cond: Column, field: Column, value: Column) -> Column:
        return F.when(cond, F.struct(field.alias("field"), value.cast("string").alias("value")))

    is_cost = (event == "cost") | _truthy("api_cost_usd")
    items = [
        fact((event == "phase") & known, F.concat(F.lit("phase:"), "phase"), F.concat_ws("|", status, progress)),
        fact((event == "quality") & known & F.col("score").isNotNull(), F.concat(F.lit("score:"), "phase"), F.col("score")),
        *[fact((event == "quality") & _truthy(m), F.lit(m), F.col(m)) for m in METRICS],
        fact((event == "final_score") & _truthy("final_score"), F.lit("quality_score"), F.col("final_score")),
        fact(is_cost, F.lit("cost"), F.concat_ws("|", F.coalesce("api_cost_usd", F.lit(0.0)).cast("string"), F.coalesce("tokens_used", F.lit(0.0)).cast("string"))),
        fact((event == "conflict") & (F.coalesce("count", F.lit(0)) > 0), F.lit("paused"), F.col("count")),
        fact((event == "complete") & (F.col("status") == "completed"), F.lit("completed"), F.lit("completed")),
        fact(F.lit(True), F.lit("last_event"), F.col("event")),
    ]
    exploded = events.select(
        F.col(build).alias("build"), F.col(ord_).alias("ord"),
        F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("f"))
    return exploded.select("build", "f.field", "ord", "f.value")


def current(fact_rows: DataFrame) -> DataFrame:
    """Latest fact per (build, field)."""
    return fact_rows.groupBy("build", "field").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))


# --- views over the current facts ----------------------------------------------------------------


def phase_states(state: DataFrame) -> DataFrame:
    """(build, phase, status, progress) for the seven phases of every build.

    A phase is done if a higher phase reported after it; completion ends all.
    """
    own = state.filter(F.col("field").startswith("phase:")).select(
        "build", F.substring("field", 8, 1).cast("int").alias("rank"), F.split("value", "\\|").alias("v"), "ord")
    done = state.filter("field = 'completed'").select("build", F.lit(True).alias("completed"))
    grid = state.select("build").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1))))
    # Seven rows per build.
    above = W.partitionBy("build").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, -1)
    full = grid.join(own, ["build", "rank"], "left").withColumn("_later", F.max("ord").over(above)).join(done, "build", "left")
    passed = F.coalesce(F.col("_later") > F.coalesce("ord", F.lit(-1)), F.lit(False))
    status = F.coalesce(F.col("v")[0], F.lit("pending"))
    ended = F.coalesce("completed", F.lit(False))
    return full.select(
        "build", F.concat(F.lit("p"), F.col("rank").cast("string")).alias("phase"),
        F.when(ended | (passed & (status != "done")), "done").otherwise(status).alias("status"),
        F.when(ended | (passed & (status != "done")), 100).otherwise(F.coalesce(F.col("v")[1].cast("int"), F.lit(0))).alias("progress"))


def phase_gates(state: DataFrame, gate: float = 70.0) -> DataFrame:
    s = state.filter(F.col("field").startswith("score:"))
    score = F.col("value").cast("double")
    return s.select("build", F.substring("field", 7, 2).alias("phase"), score.alias("score"), (score >= gate).alias("passed"))


def build_metrics(state: DataFrame) -> DataFrame:
    """Latest non-zero value per metric; a zero never overwrites."""
    return state.groupBy("build").agg(
        *[F.max(F.when(F.col("field") == m, F.col("value").cast("double"))).alias(m) for m in METRICS])


def running_cost(state: DataFrame) -> DataFrame:
    v = F.split("value", "\\|")
    return state.filter("field = 'cost'").select(
        "build", v[0].cast("double").alias("api_cost_usd"), v[1].cast("double").alias("tokens_used"))


def build_status(state: DataFrame) -> DataFrame:
    """paused while a conflict is newer than a completion, else completed or running."""
    a = state.groupBy("build").agg(
        F.max(F.when(F.col("field") == "paused", F.col("ord"))).alias("p"), F.max(F.when(F.col("field") == "paused", F.col("value"))).alias("conflicts"),
        F.max(F.when(F.col("field") == "completed", F.col("ord"))).alias("c"))
    paused = F.col("p").isNotNull() & (F.col("c").isNull() | (F.col("p") > F.col("c")))
    return a.select(
        "build", F.when(paused, "paused").when(F.col("c").isNotNull(), "completed").otherwise("running").alias("status"),
        F.when(F.col("p").isNotNull(), "pending").otherwise("none").alias("review_status"), F.col("conflicts").cast("int").alias("conflicts"))


def cost_steps(events: DataFrame, build: str, ord_: str) -> DataFrame:
    """Cost increments between consecutive reports of a build, from per-event cumulative values."""
    rows = events.filter((F.col("event") == "cost") | _truthy("api_cost_usd")).select(
        F.col(build).alias("build"), F.col(ord_).alias("ord"), F.coalesce("api_cost_usd", F.lit(0.0)).alias("cost"))
    # The previous report is the row with the rank before: an equi-join on (build, rank) is
    # balanced even if one build reports most of the costs.
    placed = ranked(rows, [F.col("ord")], "_n", ["build"])
    before = placed.select("build", (F.col("_n") + 1).alias("_n"), F.col("cost").alias("_before"))
    return placed.join(before, ["build", "_n"], "left").select(
        "build", "ord", "cost", (F.col("cost") - F.coalesce("_before", F.lit(0.0))).alias("delta"))


def replay(logs: DataFrame, build: str, ord_: str, limit: int = 500) -> DataFrame:
    """First ``limit`` log rows of every build, for a late subscriber."""
    w = W.partitionBy(build).orderBy(ord_)
    return logs.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def orphans(builds: DataFrame, live: DataFrame, key: str, status: str) -> DataFrame:
    """Builds still running or queued that no worker holds become failed."""
    open_ = builds.filter(F.col(status).isin("running", "queued"))
    return open_.join(live.select(key), key, "left_anti").withColumn(status, F.lit("failed"))


def retained(builds: DataFrame, logs: DataFrame, expired: DataFrame, key: str, log_key: str) -> tuple[DataFrame, DataFrame]:
    """Builds and logs that stay after the expired builds are removed."""
    kept = builds.join(expired.select(key), key, "left_anti")
    return kept, logs.join(kept.select(F.col(key).alias(log_key)), log_key, "left_semi")
