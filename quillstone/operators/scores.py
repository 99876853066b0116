"""Scorecards: every one is a single aggregate followed by a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, constants as K, text as T
from ..session import materialise
from .joins import salted_join


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def verification(evidence: DataFrame, sample_pct: int) -> DataFrame:
    """Evidence rate 50, mean match of the found 30, sampling share 20."""
    agg = evidence.agg(
        F.count("*").alias("sampled"), F.count(F.when(F.col("found"), 1)).alias("verified"),
        F.coalesce(F.avg(F.when(F.col("found"), F.col("match_score"))), F.lit(0.0)).alias("_match"),
    )
    score = (
        F.col("verified") / F.greatest("sampled", F.lit(1)) * 50 + F.col("_match") / 100 * 30
        + F.lit(min(1.0, sample_pct / 100)) * 20
    )
    return agg.select(clamp(score).alias("score"), "verified", "sampled")


# --- per phase -----------------------------------------------------------------------------------


def _depth(words: Column) -> Column:
    return (
        F.when(words.between(200, 5000), 1.0).when(words.between(50, 199), 0.5).when(words > 5000, 0.7).otherwise(0.1)
    )


def _keywords_hit(content: Column, kws: Column) -> Column:
    return arrays.let(F.lower(content), lambda low: F.size(F.filter(kws, lambda k: F.instr(low, k) > 0)))


def baseline_quality(refs: DataFrame, group: str, content: str, domain_words: DataFrame) -> DataFrame:
    """Depth 40, diversity 30, relevance 30 per baseline.

    ``domain_words`` (group, words) holds the few domain words of a baseline.
    Diversity is 1 - mean pairwise overlap of top-20 keyword sets; the sum over
    pairs is taken per keyword from counts by set size (at most 20 sizes), so
    no pair is ever built.
    """
    r = salted_join(refs, domain_words, [group], F.monotonically_increasing_id(), "left").select(
        group, _depth(T.word_count(F.col(content))).alias("depth"),
        T.keywords(F.col(content), 20, (), 4, 30).alias("kws"),
        F.when(F.size("words") > 0, (_keywords_hit(F.col(content), F.col("words")) >= 2).cast("int")).alias("relevant"))
    r = materialise(r, "references")
    totals = r.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("depth").alias("depth"), F.avg("relevant").alias("relevance"),
        F.count(F.when(F.size("kws") > 0, 1)).alias("filled"))
    by_size = r.select(group, F.size("kws").alias("size"), F.explode("kws").alias("kw")).groupBy(group, "kw", "size").agg(
        F.count("*").alias("c"))
    bigger = W.partitionBy(group, "kw").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    shared = by_size.withColumn("_more", F.coalesce(F.sum("c").over(bigger), F.lit(0))).groupBy(group).agg(
        F.sum((F.col("c") * (F.col("c") - 1) / 2 + F.col("c") * F.col("_more")) / F.col("size")).alias("overlap"))
    pairs = F.col("filled") * (F.col("filled") - 1) / 2
    diversity = F.when(F.col("n") >= 2, (1 - F.coalesce("overlap", F.lit(0.0)) / F.greatest(pairs, F.lit(1.0))) * 100).otherwise(0.0)
    score = F.col("depth") * 100 * 0.40 + diversity * 0.30 + F.coalesce(F.col("relevance") * 100, F.lit(50.0)) * 0.30
    scored = totals.join(shared, group, "left").select(group, clamp(score).alias("score"))
    return _with_empty(scored, domain_words, group)


EMPTY_BASELINE = 30.0


def _with_empty(scored: DataFrame, named: DataFrame, group: str) -> DataFrame:
    """Groups that are named but hold no reference get the fixed score."""
    every = named.select(group).distinct().join(scored, group, "full")
    return every.withColumn("score", F.coalesce("score", F.lit(EMPTY_BASELINE)))


def domain_words(domain: Column, topics: Column) -> Column:
    """Words of the domain name and of its first ten topics, without generic ones."""
    low = F.concat(T.tokens(F.replace(domain, F.lit("-"), F.lit(" "))),
                   F.flatten(F.transform(F.slice(topics, 1, 10), lambda t: T.tokens(t))))
    return F.array_except(F.array_distinct(low), F.array(*[F.lit(w) for w in K.GENERIC_BASELINE]))


def reference_quality(refs: DataFrame, group: str, content: str, topic_words: DataFrame) -> DataFrame:
    """Share of deep and of relevant references plus a small count bonus, 20..95."""
    r = salted_join(refs, topic_words, [group], F.monotonically_increasing_id(), "left").select(
        group, (T.word_count(F.col(content)) >= 200).cast("int").alias("deep"),
        F.when(F.size("words") > 0, (_keywords_hit(F.col(content), F.col("words")) >= 2).cast("int")).alias("relevant"))
    a = r.groupBy(group).agg(F.count("*").alias("n"), F.avg("deep").alias("deep"), F.avg("relevant").alias("relevant"))
    score = (
        F.col("deep") * 100 * 0.45 + F.coalesce(F.col("relevant") * 100, F.lit(50.0)) * 0.45 + F.least(F.lit(15.0), F.col("n") * 1.5))
    scored = a.select(group, "n", clamp(score, 20.0, 95.0).alias("score"))
    return _with_empty(scored, topic_words, group).withColumn("n", F.coalesce("n", F.lit(0)))


def topic_words(topics: Column) -> Column:
    """Lower-cased words of at least four characters of the first ten topics."""
    low = F.flatten(F.transform(F.slice(topics, 1, 10), lambda t: T.tokens(t, 4)))
    return F.array_except(F.array_distinct(low), F.array(*[F.lit(w) for w in K.GENERIC_TOPIC]))


def inventory(topics: DataFrame, group: str, transcripts: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Density 30, depth mix 25, categories 20, coverage balance 25 (50 without a baseline)."""
    depth = F.when(F.col("depth").isin("deep", "moderate", "mention_only"), F.col("depth")).otherwise("surface")

    def share(d: str) -> Column:
        return F.avg((depth == d).cast("int"))

    filled = F.when(F.length(T.strip(F.col("category"))) > 0, F.col("category"))
    # Categories are combined per group first, so the distinct count stays small.
    cats = topics.select(group, filled.alias("c")).distinct().groupBy(group).agg(F.count("c").alias("cats"))
    a = topics.groupBy(group).agg(
        F.count("*").alias("n"), share("deep").alias("deep"), share("moderate").alias("moderate"), share("mention_only").alias("mention"),
    ).join(cats, group).join(transcripts, group, "left")
    per = F.col("n") / F.greatest(F.coalesce("transcripts", F.lit(0)), F.lit(1))
    density = (
        F.when(per.between(8, 25), 100.0).when(per < 8, F.greatest(F.lit(40.0), per / 8 * 100))
        .otherwise(F.greatest(F.when(F.col("n") > 100, 85.0).otherwise(70.0), 100.0 - (per - 25) * 2)))
    mix = F.least(F.lit(100.0), (
        F.least("deep", F.lit(0.4)) / 0.4 * 40 + F.least("moderate", F.lit(0.4)) / 0.4 * 35
        + (1.0 - F.least("mention", F.lit(0.3))) / 0.7 * 25))
    category = (
        F.when(F.col("cats") >= 5, 100.0).when(F.col("cats") >= 3, 80.0).when(F.col("cats") >= 2, 60.0)
        .when(F.col("cats") == 1, 40.0).otherwise(20.0))
    balance = F.lit(50.0)
    if coverage is not None:
        a = a.join(coverage, group, "left")
        total = F.greatest("total", F.lit(1))
        gap, over, uniq = (F.col(c) / total for c in ("gap_count", "overlap_count", "unique_expert_count"))
        zero = F.lit(0.0)
        parts = (
            F.when(over.between(0.15, 0.85), 35.0).otherwise(F.greatest(zero, 35 - F.abs(over - 0.50) * 50))
            + F.when(uniq.between(0.05, 0.60), 35.0).otherwise(F.greatest(zero, 35 - F.abs(uniq - 0.30) * 70))
            + F.when(gap <= 0.35, 30.0).otherwise(F.greatest(zero, 30 - F.abs(gap - 0.15) * 60)))
        balance = F.when(F.col("total").isNull(), 50.0).otherwise(F.when(gap > 0.50, parts * 0.5).otherwise(parts))
    score = density * 0.30 + mix * 0.25 + category * 0.20 + balance * 0.25
    return a.select(group, clamp(score).alias("score"))


def extraction(atoms: DataFrame, group: str, chunks: DataFrame) -> DataFrame:
    """Structural checks 60, atoms per chunk 40, bonus for both streams; mean confidence."""
    body = F.col("content")
    passed = sum(c.cast("int") for c in (
        F.length(body).between(100, 2000), T.ends_sentence(body),
        (F.length(T.strip(F.col("category"))) > 0) & (T.strip(F.col("category")) != "general"),
        F.size("tags") >= 2, T.word_count(F.col("title")) >= 3))
    a = atoms.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(passed).alias("passed"), F.avg("confidence").alias("confidence"),
        F.max((F.col("source") == "transcript").cast("int")).alias("has_t"), F.max(F.col("gap_filled").cast("int")).alias("has_g"),
    ).join(chunks, group, "left")
    per = F.col("n") / F.greatest(F.coalesce("chunks", F.lit(0)), F.lit(1))
    complete = (
        F.when(per.between(8, 15), 100.0).when(per < 8, F.greatest(F.lit(50.0), per / 8 * 100))
        .otherwise(F.greatest(F.lit(70.0), 100.0 - (per - 15) * 3)))
    bonus = F.when((F.col("has_t") == 1) & (F.col("has_g") == 1), 5.0).otherwise(0.0)
    score = F.col("passed") / (F.col("n") * 5) * 100 * 0.6 + complete * 0.4 + bonus
    return a.select(group, F.least(F.lit(100.0), score).alias("score"), F.bround("confidence", 3).alias("avg_confidence"))


def dedup(counts: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """Kept ratio against an ideal band by set size, merge bonus, integrity penalty.

    ``counts``: group, n (atoms after cross-source removal), duplicates.
    """
    body = F.col("content")
    bad = (
        F.when((F.length(body) > 20) & ~T.ends_sentence(body), 2.0).otherwise(0.0)
        + F.when(F.length(T.strip(F.coalesce("category", F.lit("")))) == 0, 3.0).otherwise(0.0))
    k = kept.groupBy(group).agg(F.count("*").alias("kept"), F.sum(bad).alias("penalty"))
    a = counts.join(k, group, "left")
    n = F.col("n")
    low = F.when(n < 30, 0.70).when(n < 100, 0.50).otherwise(0.40)
    high = F.when(n < 30, 0.95).when(n < 100, 0.85).otherwise(0.75)
    ratio = F.coalesce("kept", F.lit(0)) / n
    band = (
        F.when(ratio.between(low, high), 90.0).when(ratio > high, 90.0 - (ratio - high) / (1.0 - high) * 25.0)
        .otherwise(90.0 - (low - ratio) / low * 40.0))
    score = band + F.least(F.lit(10.0), F.col("duplicates") * 2.0) - F.least(F.lit(20.0), F.coalesce("penalty", F.lit(0.0)))
    return a.select(group, F.when(n > 0, clamp(score)).otherwise(0.0).alias("score"))


def weighted_build(phases: DataFrame, builds: DataFrame, key: str) -> DataFrame:
    """Weighted phase scores with the three hard penalties, in order.

    ``phases``: key, phase, score; ``builds``: key, atoms, input_pages.
    """
    def of(p: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("phase") == p, F.col("score"))), F.lit(0.0))

    p = phases.groupBy(key).agg(*[of(x).alias(x) for x in K.PHASE_WEIGHTS])
    total = clamp(sum(F.col(x) * w for x, w in K.PHASE_WEIGHTS.items()))
    s1 = F.when(F.col("p0") < 50, F.least(total, F.lit(60.0))).otherwise(total)
    s2 = F.when(F.col("p4") < 30, s1 * 0.8).otherwise(s1)
    thin = (F.col("atoms") < 10) & (F.col("input_pages") > 20)
    s3 = F.when(thin, F.greatest(F.lit(0.0), s2 - 20)).otherwise(s2)
    return builds.join(p, key, "left").na.fill(0.0, list(K.PHASE_WEIGHTS)).select(key, s3.alias("score"))


def presence(checks: list[Column]) -> Column:
    """Share of passed presence checks, in percent."""
    return sum(c.cast("int") for c in checks) / len(checks) * 100.0


def compression(kept: DataFrame, inputs: DataFrame, group: str, kept_text: str, input_text: str) -> DataFrame:
    out = kept.groupBy(group).agg(F.sum(T.word_count(F.col(kept_text))).alias("output_words"))
    inp = inputs.groupBy(group).agg(F.sum(T.word_count(F.col(input_text))).alias("input_words"))
    words = F.when(F.coalesce("input_words", F.lit(0)) == 0, F.col("output_words") * 10).otherwise(F.col("input_words"))
    return out.join(inp, group, "left").select(
        group, "output_words", words.alias("input_words"), (F.col("output_words") / F.greatest(words, F.lit(1))).alias("ratio"))


def smoke_test(results: DataFrame, group: str, threshold: float = 0.6) -> DataFrame:
    weight = F.lit(0.33)
    for tier, w in K.TIER_WEIGHTS.items():
        weight = F.when(F.coalesce("tier", F.lit("applied")) == tier, w).otherwise(weight)
    r = results.withColumn("_w", weight)
    a = r.groupBy(group).agg(
        F.count(F.when(F.col("score") >= 0.6, 1)).alias("pass_count"), F.count("*").alias("total"),
        (F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("score"))
    return a.withColumn("passed", F.col("score") >= threshold)


def trigger_accuracy(results: DataFrame, group: list[str]) -> DataFrame:
    """Share of right trigger decisions per group and split."""
    right = F.col("triggered") == F.col("should_trigger")
    return results.groupBy(*group).agg(F.avg(right.cast("int")).alias("accuracy"), F.count("*").alias("n"))


def trigger_errors(results: DataFrame) -> DataFrame:
    wrong = results.filter(F.col("triggered") != F.col("should_trigger"))
    return wrong.withColumn("error", F.when(F.col("should_trigger"), "MISSED").otherwise("FALSE TRIGGER"))


def best_iteration(accuracy: DataFrame, key: str) -> DataFrame:
    """Best iteration by test, then train accuracy; the first of equals, nothing below zero start."""
    wide = accuracy.groupBy(key, "iteration").agg(
        F.coalesce(F.max(F.when(F.col("split") == "test", F.col("accuracy"))), F.lit(0.0)).alias("test"),
        F.coalesce(F.max(F.when(F.col("split") == "train", F.col("accuracy"))), F.lit(0.0)).alias("train"))
    better = wide.filter((F.col("test") > 0) | (F.col("train") > 0))
    top = better.groupBy(key).agg(F.max(F.struct("test", "train", (-F.col("iteration")).alias("neg"))).alias("b"))
    return top.select(key, (-F.col("b.neg")).alias("iteration"), F.col("b.test").alias("test"), F.col("b.train").alias("train"))


def final_score(pipeline: Column, smoke: Column, trigger: Column) -> Column:
    """struct<score, grade, verdict, strengths, weaknesses> of a build."""
    score = clamp(F.bround(pipeline * 0.6 + smoke * 0.3 + trigger * 0.1, 1))
    grade = F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")

    verdict = F.create_map(*[F.lit(x) for pair in K.VERDICTS.items() for x in pair])[grade]

    def listed(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    def note(cond: Column, text: str, value: Column | None = None) -> Column:
        return F.when(cond, F.format_string(text, F.bround(value, 0)) if value is not None else F.lit(text))

    return F.struct(
        score.alias("score"), grade.alias("grade"), verdict.alias("verdict"),
        listed(
            note(pipeline >= 80, "Strong pipeline quality (%.0f/100)", pipeline),
            note(smoke >= 70, "Good smoke test results (%.0f%%)", smoke),
            note(trigger >= 80, "Excellent trigger accuracy (%.0f%%)", trigger),
        ).alias("strengths"),
        listed(
            note(pipeline < 60, "Low pipeline quality (%.0f/100)", pipeline),
            note((smoke > 0) & (smoke < 50), "Low smoke test (%.0f%%) — skill may answer incorrectly", smoke),
            note(smoke == 0, "No smoke test results — quality unverified"),
            note((trigger > 0) & (trigger < 60), "Low trigger accuracy (%.0f%%) — skill may not activate", trigger),
        ).alias("weaknesses"),
    )


def cost(usage: DataFrame, group: list[str]) -> DataFrame:
    """Dollars per group from token counts and the price table (decimal arithmetic)."""
    def price(i: int) -> Column:
        out = F.lit(str(K.DEFAULT_PRICE[i])).cast("decimal(10,4)")
        for model, p in K.MODEL_PRICES.items():
            out = F.when(F.col("model") == model, F.lit(str(p[i])).cast("decimal(10,4)")).otherwise(out)
        return out

    inp, out = F.col("input_tokens").cast("decimal(18,0)"), F.col("output_tokens").cast("decimal(18,0)")
    # The price is known in the row, so one aggregate does; dollars are divided once per group.
    return usage.groupBy(*group).agg(
        F.sum((inp * price(0) + out * price(1)).cast("decimal(28,4)")).alias("_usd"), F.sum(inp + out).cast("long").alias("tokens")).select(
        *group, (F.col("_usd") / F.lit(1000000)).cast("decimal(18,6)").alias("cost_usd"), "tokens")


def dashboard(builds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return builds.groupBy(*(by or [])).agg(
        F.count("*").alias("total_builds"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed_builds"),
        F.round(F.avg("quality_score"), 1).alias("avg_quality"),
        F.coalesce(F.sum(F.coalesce("atoms_verified", "atoms_extracted")), F.lit(0)).alias("total_atoms"),
        F.round(F.coalesce(F.sum("api_cost_usd"), F.lit(0.0)), 2).alias("total_cost"),
        F.count(F.when(F.col("status") == "running", 1)).alias("running_builds"),
    )


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400
    return entries.groupBy("kind").agg(
        F.count("*").alias("entries"), F.sum("bytes").alias("bytes"),
        F.round(F.max(age), 6).alias("oldest_days"), F.round(F.min(age), 6).alias("newest_days"))


def cache_purge(entries: DataFrame, now: Column, older_than_days: int | None) -> DataFrame:
    """Entries that stay; None purges everything."""
    if older_than_days is None:
        return entries.filter(F.lit(False))
    return entries.filter(F.col("ts") >= now - F.expr(f"INTERVAL {older_than_days} DAYS"))
