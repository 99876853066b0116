"""Band edges, ranking and streaming state."""

import random

from pyspark.sql import functions as F

from quillstone.operators import dedup, evidence, matching, publish, ranking, scores
from quillstone.streaming import events


def test_adaptive_threshold(spark):
    df = spark.createDataFrame([(25,), (45,), (80,), (150,)], "n long")
    got = [round(r.t, 2) for r in df.select(dedup.adaptive_threshold(0.8, F.col("n")).alias("t")).collect()]
    assert got == [0.65, 0.70, 0.75, 0.80]
    assert spark.range(1).select(dedup.adaptive_threshold(0.5, F.lit(10)).alias("t")).first().t == 0.5


def test_weighted_build_penalties(spark):
    phases = spark.createDataFrame(
        [(b, p, s) for b, ss in (("low0", (40, 80, 85, 75, 90)), ("low4", (90, 80, 85, 75, 20)), ("thin", (90, 80, 85, 75, 90)))
         for p, s in zip(("p0", "p1", "p2", "p3", "p4", "p5"), (*map(float, ss), 100.0))], "k string, phase string, score double")
    builds = spark.createDataFrame([("low0", 50, 5), ("low4", 50, 5), ("thin", 9, 21), ("none", 50, 5)], "k string, atoms int, input_pages int")
    got = {r.k: r.score for r in scores.weighted_build(phases, builds, "k").collect()}
    assert got["low0"] == 60.0
    assert abs(got["low4"] - 0.8 * (13.5 + 8 + 21.25 + 11.25 + 4 + 15)) < 1e-9
    assert abs(got["thin"] - (13.5 + 8 + 21.25 + 11.25 + 18 + 15 - 20)) < 1e-9
    assert got["none"] == 0.0


def test_grades_at_edges(spark):
    edges = [(80.0, "A"), (79.9, "B"), (65.0, "B"), (50.0, "C"), (35.0, "D"), (34.0, "F")]
    df = spark.createDataFrame([(s,) for s, _ in edges], "s double")
    rows = df.select(scores.final_score(F.col("s"), F.col("s"), F.col("s")).alias("f")).collect()
    assert [r.f.grade for r in rows] == [g for _, g in edges]


def test_good_baseline_beats_bad_one(spark):
    good = [("good", " ".join(f"topic{i} word{i}x{j} facebook ads" for j in range(70))) for i in range(10)]
    bad = [("bad", "short stub") for _ in range(10)]
    refs = spark.createDataFrame(good + bad, "g string, content string")
    words = spark.createDataFrame([("good", ["facebook", "ads"]), ("bad", ["facebook", "ads"])], "g string, words array<string>")
    got = {r.g: r.score for r in scores.baseline_quality(refs, "g", "content", words).collect()}
    assert got["good"] - got["bad"] >= 20


def test_ranked_matches_sort_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else str(i % 3), rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(4)
    got = {r.id: r.rn for r in ranking.ranked(df, [F.col("v"), F.col("id")], "rn", ["g"], ranges=31).collect()}
    for g in {r[0] for r in rows}:
        want = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        assert [got[i] for i in want] == list(range(1, len(want) + 1))
    tot = ranking.running_total(df, [F.col("id")], F.lit(2), "s", ranges=7).orderBy("id").collect()
    assert [r.s for r in tot] == [2 * (i + 1) for i in range(3000)]


def test_sample_size_is_exact(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    assert evidence.sample_for_tier(df, "k", "draft").count() == 30
    assert evidence.sample_for_tier(df, "k", "premium").count() == 101
    assert evidence.sample_for_tier(df.limit(1), "k", "draft").count() == 1


def test_contains_join_equals_plain_contains(spark):
    rng = random.Random(4)
    letters = "abc"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    kws = {word(rng.randrange(3, 12)) for _ in range(60)}
    refs = [(i, " ".join(word(rng.randrange(1, 25)) for _ in range(12))) for i in range(20)]
    k = spark.createDataFrame([(x,) for x in kws], "kw string")
    r = spark.createDataFrame(refs, "ref long, t string")
    occ = matching.occurrences(k, r, "ref", matching.word_tokens(F.col("t")))
    assert {(x.kw, x.ref) for x in occ.collect()} == {(x, i) for x in kws for i, t in refs if x in t}
    plan = occ._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_evidence_bands(spark):
    words = [f"word{c}" for c in "abcdefghij"]
    atoms = spark.createDataFrame([(1, " ".join(words)), (2, "123 45"), (3, " ".join(words))], "id long, text string")
    refs = spark.createDataFrame([(0, "r0", "prefix" + " ".join(words[:4])), (1, "r1", "unrelated")], "ref long, path string, content string")
    got = {r.id: r for r in evidence.search(atoms, "id", "text", refs, "ref", "path", "content").collect()}
    assert got[1].match_score == 40.0 and got[1].band == "weak" and got[1].file == "r0"
    assert not got[2].found and got[2].match_score == 0.0 and got[2].keywords_total == 0


def test_lint_counts_lines_outside_front_matter(spark):
    body = "---\nname: x\n---\n" + "\n".join(["line"] * 501)
    df = spark.createDataFrame([("word " * 60, body)], "d string, b string")
    assert df.select(publish.lint_document(F.col("d"), F.col("b")).alias("w")).first().w == ["body over 500 lines"]


def test_state_does_not_depend_on_order_or_repeats(spark):
    lines = [
        (1, '{"event": "phase", "phase": "p1", "status": "running", "progress": 40}'), (2, '{"event": "phase", "phase": "p0", "status": "done", "progress": 90}'),
        (3, '{"event": "phase", "phase": "p2", "status": "running", "progress": 150}'), (4, '{"event": "quality", "quality_score": 71.5}'),
        (5, '{"event": "quality", "quality_score": 0}'), (6, "not json"), (7, '{"event": "conflict", "count": 0}'), (8, '{"event": "phase", "phase": "p55", "status": "done"}'),
        (9, '{"event": "log", "api_cost_usd": 1.5, "tokens_used": 7}'), (10, '{"event": "odd"}')]
    rng = random.Random(6)
    for _ in range(2):
        rows = lines + lines[:4]
        rng.shuffle(rows)
        df = spark.createDataFrame([(1, *r) for r in rows], "build long, ord long, line string")
        parsed = events.parse(df, "line")
        state = events.current(events.facts(parsed, "build", "ord")).cache()
        phases = {r.phase: (r.status, r.progress) for r in events.phase_states(state).collect()}
        assert phases["p0"] == ("done", 90) and phases["p1"] == ("done", 100) and phases["p2"] == ("running", 100) and phases["p3"] == ("pending", 0)
        assert events.build_metrics(state).first().quality_score == 71.5
        assert events.build_status(state).first().status == "running"
        assert events.running_cost(state).first().api_cost_usd == 1.5
        assert {r.ord for r in parsed.filter("not is_json").collect()} == {6}
