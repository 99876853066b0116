"""Queries over build events: batch views, streaming runs, insight rules, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as N, registry_tables as R
from ..streaming import events as E, live
from . import sqlparts as S
from .registry import query, table
from .report_plans import _BUILDS, _builds

# --- events as log lines -------------------------------------------------------------------------


def _with_lines(e):
    """Log line per event: JSON built from the row, or plain text for one in 41."""
    i, v = F.col("event_id"), F.col("value")
    kind = F.create_map(*[F.lit(x) for x in ("view", "phase", "click", "quality", "purchase", "cost", "error", "conflict")])
    event = F.when(i % 50 == 0, "final_score").when(i % 97 == 0, "complete").otherwise(kind[F.col("event_type")])
    phase = F.when(i % 29 == 0, "p55").otherwise(F.concat(F.lit("p"), (i % 7).cast("string")))
    whole = F.floor(v)
    body = F.to_json(F.struct(
        event.alias("event"), phase.alias("phase"), F.when(i % 97 == 0, "completed").when(i % 5 == 0, "done").when(i % 11 == 0, "failed").otherwise("running").alias("status"),
        F.when(i % 3 == 0, "warn").alias("level"), F.when(i % 4 > 0, F.col("props")).alias("message"), whole.alias("progress"),
        (whole % 101).alias("score"), F.when(i % 6 > 0, whole % 90).otherwise(0).alias("quality_score"), (i % 99).alias("final_score"), (i % 8).alias("atoms_extracted"),
        F.when(i % 7 == 0, i % 13).alias("atoms_verified"), F.when((event == "cost") | (i % 31 == 0), whole / 4).alias("api_cost_usd"), F.when(i % 2 == 0, i).alias("tokens_used"),
        (i % 3).cast("int").alias("count")))
    return e.select("event_id", "ts", "user_id", F.when(i % 41 == 0, F.concat(F.lit("plain "), F.col("event_type"))).otherwise(body).alias("line"))


_LINES = """l AS (SELECT event_id AS i, ts, user_id AS build, event_id % 41 <> 0 AS js, floor(value) AS w, event_type, props,
 CASE WHEN event_id % 41 = 0 THEN 'log' WHEN event_id % 50 = 0 THEN 'final_score' WHEN event_id % 97 = 0 THEN 'complete' WHEN event_type = 'view' THEN 'phase' WHEN event_type = 'click' THEN 'quality'
  WHEN event_type = 'purchase' THEN 'cost' WHEN event_type = 'error' THEN 'conflict' ELSE 'log' END AS event,
 CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'p55' ELSE 'p' || (event_id % 7) END AS phase,
 CASE WHEN event_id % 97 = 0 THEN 'completed' WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 11 = 0 THEN 'failed' ELSE 'running' END AS status FROM events)"""


def _parsed(spark, sf):
    return E.parse(_with_lines(table(spark, sf, "events")), "line")


def _state(spark, sf):
    return E.current(E.facts(_parsed(spark, sf), "user_id", "event_id"))


def _stream(spark, sf):
    """The same lines as a file stream."""
    src = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(src).option("pathGlobFilter", "events.parquet").parquet(sf)
    return E.parse(_with_lines(raw), "line")


@query("event_parse", "R1", f"""WITH {_LINES}
SELECT i AS event_id, js AS is_json, event, CASE WHEN js AND i % 3 = 0 THEN 'warn' ELSE 'info' END AS level, phase, CASE WHEN NOT js THEN 'plain ' || event_type WHEN i % 4 > 0 THEN props ELSE 'whole line' END AS message FROM l""")
def event_parse(spark, sf):
    p = _parsed(spark, sf)
    return p.select("event_id", "is_json", "event", "level", "phase", F.when(F.col("is_json") & (F.col("message") == F.col("line")), "whole line").otherwise(F.col("message")).alias("message"))


_PHASE_SQL = """own AS (SELECT build, CAST(substring(phase, 2) AS INT) AS rank, arg_max(CASE WHEN status = 'done' THEN status ELSE 'running' END, i) AS st, arg_max(CAST(greatest(0, least(100, w)) AS INT), i) AS pr, max(i) AS o
  FROM l WHERE event = 'phase' AND length(phase) = 2 GROUP BY 1, 2),
g AS (SELECT DISTINCT build, r.rank FROM l CROSS JOIN range(7) r(rank)), done AS (SELECT DISTINCT build FROM l WHERE event = 'complete' AND status = 'completed'),
x AS (SELECT g.build, g.rank, coalesce(st, 'pending') AS st, coalesce(pr, 0) AS pr, (SELECT max(o) FROM own h WHERE h.build = g.build AND h.rank > g.rank) > coalesce(o, -1) AS passed, g.build IN (SELECT build FROM done) AS fin FROM g LEFT JOIN own USING (build, rank)),
ph AS (SELECT build, 'p' || rank AS phase, CASE WHEN fin OR (passed AND st <> 'done') THEN 'done' ELSE st END AS status, CASE WHEN fin OR (passed AND st <> 'done') THEN 100 ELSE pr END AS progress FROM x)"""


@query("phase_states", "R2", f"WITH {_LINES}, {_PHASE_SQL} SELECT * FROM ph")
def phase_states(spark, sf):
    return E.phase_states(_state(spark, sf))


@query("live_phase_states", "R2 R1 F5", f"WITH {_LINES}, {_PHASE_SQL} SELECT * FROM ph")
def live_phase_states(spark, sf):
    return E.phase_states(live.run_live_state(_stream(spark, sf), "user_id", "event_id"))


@query("phase_gates", "R3", f"WITH {_LINES}, s AS (SELECT build, phase, arg_max(w % 101, i) AS score FROM l WHERE event = 'quality' AND length(phase) = 2 GROUP BY 1, 2) SELECT *, score >= 70 AS passed FROM s")
def phase_gates(spark, sf):
    return E.phase_gates(_state(spark, sf))


_METRIC_SQL = """q AS (SELECT build, i, CASE WHEN event = 'quality' AND i % 6 > 0 THEN w % 90 WHEN event = 'final_score' THEN i % 99 END AS q, CASE WHEN event = 'quality' THEN i % 8 END AS e, CASE WHEN event = 'quality' AND i % 7 = 0 THEN i % 13 END AS v FROM l),
m AS (SELECT build, arg_max(q, i) FILTER (q <> 0) AS quality_score, arg_max(e, i) FILTER (e <> 0) AS atoms_extracted, arg_max(v, i) FILTER (v <> 0) AS atoms_verified FROM q GROUP BY 1)"""


@query("build_metrics", "R3 R6", f"WITH {_LINES}, {_METRIC_SQL} SELECT * FROM m")
def build_metrics(spark, sf):
    return E.build_metrics(_state(spark, sf)).select("build", "quality_score", "atoms_extracted", "atoms_verified")


@query("live_build_metrics", "R3 R6", f"WITH {_LINES}, {_METRIC_SQL} SELECT * FROM m")
def live_build_metrics(spark, sf):
    s = live.run_live_state(_stream(spark, sf), "user_id", "event_id")
    return E.build_metrics(s).select("build", "quality_score", "atoms_extracted", "atoms_verified")


_COST_ROWS = "c AS (SELECT build, i, CASE WHEN event = 'cost' OR i % 31 = 0 THEN w / 4 END AS cost, CASE WHEN i % 2 = 0 THEN i ELSE 0 END AS tok FROM l WHERE js AND (event = 'cost' OR (i % 31 = 0 AND w > 0)))"


@query("running_cost", "R4", f"WITH {_LINES}, {_COST_ROWS} SELECT build, arg_max(cost, i) AS api_cost_usd, arg_max(tok, i) AS tokens_used FROM c GROUP BY 1")
def running_cost(spark, sf):
    return E.running_cost(_state(spark, sf))


@query("cost_steps", "R4", f"WITH {_LINES}, {_COST_ROWS} SELECT build, i AS ord, cost, cost - coalesce(lag(cost) OVER (PARTITION BY build ORDER BY i), 0) AS delta FROM c")
def cost_steps(spark, sf):
    return E.cost_steps(_parsed(spark, sf), "user_id", "event_id")


@query("build_status", "R5 R6", f"""WITH {_LINES}, a AS (SELECT build, max(i) FILTER (event = 'conflict' AND i % 3 > 0) AS p, arg_max(i % 3, i) FILTER (event = 'conflict' AND i % 3 > 0) AS conflicts, max(i) FILTER (event = 'complete') AS c FROM l GROUP BY 1)
SELECT build, CASE WHEN p IS NOT NULL AND (c IS NULL OR p > c) THEN 'paused' WHEN c IS NOT NULL THEN 'completed' ELSE 'running' END AS status, CASE WHEN p IS NULL THEN 'none' ELSE 'pending' END AS review_status, conflicts FROM a""")
def build_status(spark, sf):
    return E.build_status(_state(spark, sf))


@query("log_replay", "R7", f"WITH {_LINES}, r AS (SELECT i AS event_id, build, row_number() OVER (PARTITION BY build ORDER BY i) AS pos FROM l) SELECT * FROM r WHERE pos <= 500")
def log_replay(spark, sf):
    logs = _parsed(spark, sf).select("event_id", F.col("user_id").alias("build"))
    return E.replay(logs, "build", "event_id")


@query("log_tail", "R7", f"WITH {_LINES} SELECT i AS event_id, event FROM l")
def log_tail(spark, sf):
    s = _stream(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    return live.run_log_tail(s.unionByName(s), "event_id", "ts").select("event_id", "event")


@query("live_liveness", "R8 F5", f"WITH {_LINES} SELECT build, max(i) AS last_ord, count(*) AS events, CASE WHEN bool_or(event = 'complete') THEN 'completed' ELSE 'running' END AS status FROM l GROUP BY 1")
def live_liveness(spark, sf):
    return live.run_liveness(_stream(spark, sf), "user_id", "event_id")


@query("orphaned_builds", "R8", f"WITH {_BUILDS} SELECT id, 'failed' AS status FROM b WHERE status IN ('running', 'queued') AND id NOT IN (SELECT user_id FROM events)")
def orphaned_builds(spark, sf):
    held = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return E.orphans(_builds(spark, sf).select("id", "status"), held, "id", "status")


_CUT = "2000-01-31 00:00:00"
_OLD = f"b.status IN ('completed', 'failed') AND b.created_at < TIMESTAMP '{_CUT}' - INTERVAL 30 DAY"


def _retained(spark, sf):
    b = _builds(spark, sf)
    old = R.expired(b, F.lit(_CUT).cast("timestamp"), 30, "created_at", "status", ("completed", "failed"))
    logs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("build"), "l_linenumber", "l_quantity")
    return E.retained(b, logs, old, "id", "build"), old


@query("retention_builds", "R9", f"WITH {_BUILDS} SELECT id, status FROM b WHERE NOT ({_OLD})")
def retention_builds(spark, sf):
    return _retained(spark, sf)[0][0].select("id", "status")


@query("retention_logs", "R9", f"WITH {_BUILDS} SELECT l_orderkey AS build, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT id FROM b WHERE NOT ({_OLD})) GROUP BY 1")
def retention_logs(spark, sf):
    return _retained(spark, sf)[0][1].groupBy("build").agg(F.count("*").alias("n"))


@query("retention_freed", "R9", f"WITH {_BUILDS} SELECT count(*) AS deleted, round(sum(c), 2) AS freed FROM b WHERE {_OLD}")
def retention_freed(spark, sf):
    return _retained(spark, sf)[1].agg(F.count("*").alias("deleted"), F.round(F.sum("api_cost_usd"), 2).alias("freed"))


# --- insight rules -------------------------------------------------------------------------------


def _results(spark, sf):
    """One result per (order, phase) with metrics taken from the order line."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("k")).filter("l_linenumber <= 6")
    q, k = F.col("q"), F.col("k")

    def metrics(**m):
        return F.create_map(*[x for n, c in m.items() for x in (F.lit(n), c.cast("double"))])

    phase = F.col("l_linenumber")
    m = (F.when(phase == 1, metrics(references=k % 15)).when(phase == 2, metrics(
            topics_found=q * 10, transcripts_audited=k % 3, total=q, overlap_count=F.floor(q * (k % 11) / 10), unique_expert_count=F.floor(q * (k % 5) / 10), gap_count=F.floor(q * (k % 8) / 10)))
         .when(phase == 3, metrics(gap_fill_atoms=k % 3, code_atoms=k % 2, avg_confidence=(k % 100) / 100))
         .when(phase == 4, metrics(input_atoms=q, output_atoms=F.floor(q / 2), duplicates_merged=F.floor(q * (k % 10) / 10), conflicts_unresolved=k % 4, cross_source_contradictions=k % 2))
         .when(phase == 5, metrics(sample_pct=F.when(k % 3 == 0, 30).when(k % 3 == 1, 70).otherwise(100), verified=q, sampled=q, flagged=k % 2))
         .otherwise(metrics(pillars=q, atoms_flagged=k % 3)))
    return li.select(
        F.col("l_orderkey").alias("build"), F.concat(F.lit("p"), (phase - 1).cast("string")).alias("phase"), m.alias("metrics"),
        F.when(k % 2 == 0, "auto-discovery").alias("source"), F.when(k % 4 > 0, F.array(F.lit("web"), F.lit("api"))).otherwise(F.array().cast("array<string>")).alias("platforms"),
        (q * 2).alias("quality_score"))


_RES = "r AS (SELECT l_orderkey AS build, l_linenumber AS n, max(l_quantity) AS q, max(l_partkey) AS k FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2)"


def _t(key: str, number: str | None = None) -> str:
    text = N.TEXTS[key]
    if number is None:
        return S.q(text.replace("%%", "%"))
    a, b = text.replace("%%", "%").split("%s", 1)
    return f"{S.q(a)} || {number} || {S.q(b)}"


def _n(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


_INS = [
    ("n = 1 AND k % 15 >= 10", "good", _t("refs_many", _n("k % 15")), None), ("n = 1 AND k % 15 = 0", "critical", _t("refs_none"), None),
    ("n = 1 AND k % 15 BETWEEN 1 AND 4", "warning", _t("refs_few", _n("k % 15")), None), ("n = 1 AND k % 2 = 0", "info", _t("refs_found"), None),
    ("n = 2 AND k % 3 > 0 AND q * 10 / (k % 3) > 100", "info", _t("topics_long", _n("floor(q * 10 / (k % 3) + 0.5)")), None),
    ("n = 2 AND floor(q * (k % 11) / 10) / q > 0.8", "info", _t("cover_high", _n("floor(floor(q * (k % 11) / 10) / q * 100 + 0.5)")), None),
    ("n = 2 AND floor(q * (k % 5) / 10) / q < 0.1", "action", _t("unique_low"), "medium"),
    ("n = 2 AND floor(q * (k % 8) / 10) / q > 0.5", "critical", _t("gaps", _n("floor(q * (k % 8) / 10)")), None),
    ("n = 2 AND floor(q * (k % 8) / 10) / q > 0.2 AND floor(q * (k % 8) / 10) / q <= 0.5", "warning", _t("gaps", _n("floor(q * (k % 8) / 10)")), None),
    ("n = 3 AND k % 3 > 0", "info", _t("gap_fill", _n("k % 3")), None), ("n = 3 AND k % 2 > 0", "info", _t("code", _n("k % 2")), None),
    ("n = 3 AND k % 100 > 90", "good", _t("sure", _n("k % 100")), None), ("n = 3 AND k % 100 BETWEEN 1 AND 69", "warning", _t("unsure", _n("k % 100")), None),
    ("n = 4", "info", _t("kept", f"{_n('floor(q / 2)')} || '/' || {_n('q')} || ' (' || {_n('floor(floor(q / 2) / q * 100 + 0.5)')} || '%)'"), None),
    ("n = 4 AND floor(q * (k % 10) / 10) / q > 0.6", "tip", _t("dedup_high", _n("floor(floor(q * (k % 10) / 10) / q * 100 + 0.5)")), None),
    ("n = 4 AND k % 4 > 0", "critical", _t("unresolved", _n("k % 4")), None), ("n = 4 AND k % 2 > 0", "warning", _t("cross", _n("k % 2")), None),
    ("n = 5 AND k % 3 = 0", "warning", _t("draft"), None), ("n = 5 AND k % 3 = 2", "good", _t("premium"), None),
    ("n = 5 AND k % 2 = 0", "good", _t("all_pass"), None), ("n = 5 AND k % 2 > 0", "warning", _t("flagged", _n("k % 2")), None), ("n = 5 AND k % 3 < 2", "action", _t("tier_up"), "medium"),
    ("n = 6", "info", _t("pillars", _n("q")), None), ("n = 6 AND k % 3 > 0", "warning", _t("flagged_out", _n("k % 3")), None), ("n = 6 AND k % 4 > 0", "good", _t("packaged", "'web, api'"), None),
]


@query("phase_insights", "A23", f"WITH {_RES} " + " UNION ALL ".join(
    f"SELECT build, 'p' || (n - 1) AS phase, '{kind}' AS type, {text} AS text, {S.q(prio) if prio else 'NULL'} AS priority FROM r WHERE {cond}" for cond, kind, text, prio in _INS))
def phase_insights(spark, sf):
    return N.insights(_results(spark, sf)).drop("pos")


@query("score_breakdown", "A23", f"""WITH {_RES}, a AS (SELECT build, q * 2 AS s, CASE WHEN k % 3 > 0 THEN least(q * 10 / 5, 100) ELSE 50 END AS d, greatest(0, floor((1 - floor(q * (k % 8) / 10) / q) * 100 + 0.5)) AS b FROM r WHERE n = 2),
c AS (SELECT *, greatest(0, least(100, (s - d * 0.3 - b * 0.25) / 0.45)) AS e FROM a), u AS (SELECT build, 'Density' AS component, d AS v, d AS score, 30 AS weight FROM c UNION ALL SELECT build, 'Balance', b, b, 25 FROM c UNION ALL SELECT build, 'Depth + Category', e, floor(e + 0.5), 45 FROM c)
SELECT build, component, round(score, 6) AS score, weight, CASE WHEN v >= 70 THEN 'good' WHEN v >= 50 THEN 'warning' ELSE 'critical' END AS status FROM u""")
def score_breakdown(spark, sf):
    return N.breakdown(_results(spark, sf)).withColumn("score", F.round("score", 6))
