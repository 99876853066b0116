"""Verification of atoms against reference documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, text as T
from ..session import materialise
from .joins import salted_join
from .matching import best_reference, matched_keywords, word_tokens
from .ranking import exact_sample, ranked

STRONG, WEAK = 70.0, 40.0


def search(atoms: DataFrame, key: str, text: str, refs: DataFrame, ref: str, path: str, content: str) -> DataFrame:
    """Keyword evidence per atom: best reference, score, band, snippet, matched keywords."""
    # Ten keywords per atom feed three joins; they are counted once.
    items = materialise(atoms.select(key, T.keywords(F.col(text), 10, tuple(K.STOP_VERIFY)).alias("_kws")), "keywords")
    best = best_reference(items, key, "_kws", refs, ref, word_tokens(F.col(content)))
    # ties go to the lowest reference, so one reference may be the best of any share of the atoms
    named = salted_join(best, refs.select(ref, F.col(path).alias("_path"), F.col(content).alias("_content")), [ref], F.col(key))
    joined = items.join(named, key, "left")
    score = F.coalesce(F.col("n") / F.size("_kws") * 100, F.lit(0.0))
    hit = joined.select(
        key, ref, score.alias("_score"), F.col("_path"), F.size("_kws").alias("keywords_total"),
        F.coalesce(matched_keywords(F.col("_kws"), F.col("_content")), F.array().cast("array<string>")).alias("keywords_matched"),
        "_content",
    )
    found = F.col("_score") >= WEAK
    snip = F.when(found, T.snippet(F.col("_content"), F.col("keywords_matched")))
    return hit.withColumn("_snip", snip).select(
        key, found.alias("found"),
        F.when(F.col("_score") > 0, F.col("_path")).alias("file"),
        F.bround("_score", 1).alias("match_score"),
        F.when(F.col("_score") >= STRONG, "strong").when(found, "weak").otherwise("none").alias("band"),
        "keywords_matched", "keywords_total",
        F.col("_snip.snippet").alias("snippet"), F.col("_snip.start").alias("snippet_start"),
        F.col("_snip.end").alias("snippet_end"),
    )


def apply_evidence(atoms: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Status, confidence, note and reference of atoms after ``search``."""
    hit = F.col("found")
    note = F.format_string(
        "Verified against %s (%d/%d keywords, %s%% match)", F.col("file"), F.size("keywords_matched"),
        F.col("keywords_total"), F.format_string("%.1f", "match_score"),
    )
    return atoms.join(found, key).withColumns({
        "status": F.when(hit, "verified").otherwise("unverified"),
        "confidence": F.when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")),
        "verification_note": F.when(hit, note).otherwise("Expert insight — not found in official docs"),
        "baseline_reference": F.when(hit, F.col("file")),
    })


def vector_bands(best: DataFrame, score: str, path: str, confidence: Column) -> DataFrame:
    """Status and note from the best cosine: verified, partially verified or expert insight."""
    s = F.col(score)
    text = F.format_string("%.2f", F.bround(s, 2))
    return best.withColumns({
        "status": F.when(s >= 0.50, "verified").otherwise("unverified"),
        "method": F.when(s >= 0.70, "embedding").when(s >= 0.50, "embedding_partial").otherwise("embedding"),
        "confidence": F.when(s >= 0.70, F.least(F.lit(1.0), confidence + 0.05)).otherwise(confidence),
        "baseline_reference": F.when(s >= 0.50, F.col(path)),
        "match_score": F.bround(s * 100, 1),
        "verification_note": F.when(s >= 0.70, F.concat(F.lit("Verified (score "), text, F.lit(") against "), path))
        .when(s >= 0.50, F.concat(F.lit("Partially verified (score "), text, F.lit(") against "), path))
        .otherwise(F.concat(F.lit("Expert insight (score "), text, F.lit(") — below threshold"))),
    })


def sample_for_tier(atoms: DataFrame, key: str, tier: str = "standard") -> DataFrame:
    """Exact-size deterministic sample of the tier's share, at least one row."""
    pct = K.SAMPLE_PERCENT.get(tier, 70)
    if pct >= 100:
        return atoms
    size = atoms.agg(F.greatest(F.lit(1), F.floor(F.count("*") * pct / 100)).alias("n")).scalar()
    return exact_sample(atoms, key, size)


def mark_passthrough(atoms: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """Atoms outside the sample become ``passthrough`` with a default note."""
    flag = sampled.select(key).withColumn("_in", F.lit(True))
    return atoms.join(flag, key, "left").withColumns({
        "status": F.when(F.col("_in"), F.col("status")).otherwise("passthrough"),
        "verification_note": F.when(F.col("_in"), F.col("verification_note")).otherwise(
            F.coalesce("verification_note", F.lit("Not sampled — passed through"))),
    }).drop("_in")


def apply_verdicts(batch: DataFrame, verdicts: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Verdicts by atom; a missing one leaves the atom unverified but counted as verified."""
    v = verdicts.select(
        key, F.col("status").alias("_status"), F.col("confidence_adjustment").alias("_adj"),
        F.col("verification_note").alias("_note"), F.col("baseline_reference").alias("_ref"), F.lit(True).alias("_has"),
    )
    joined = batch.join(v, key, "left")
    has = F.coalesce("_has", F.lit(False))
    if failed is not None:
        has = has & ~failed
    missing = "Expert insight — batch verify fallback"
    note = F.when(has, F.coalesce("_note", F.lit("")))
    if failed is not None:
        note = note.when(failed, "Verification skipped: batch failed")
    return joined.withColumns({
        "status": F.when(has, F.coalesce("_status", F.lit("verified"))).otherwise("unverified"),
        "confidence": F.when(has, F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) + F.coalesce("_adj", F.lit(0.0)))).otherwise(F.col("confidence")),
        "verification_note": note.otherwise(missing),
        "baseline_reference": F.when(has, F.col("_ref")),
        "is_fallback": ~has,
    }).drop("_status", "_adj", "_note", "_ref", "_has")


def verdict_counters(done: DataFrame) -> DataFrame:
    flagged = (F.col("status") == "flagged")
    return done.agg(
        F.count(F.when(~flagged, 1)).alias("verified_count"), F.count(F.when(flagged, 1)).alias("flagged_count"),
        F.count(F.when(F.col("is_fallback"), 1)).alias("fallback_count"),
    )


def stratified_holdout(items: DataFrame, key: str, cls: str, share: float = 0.4, seed: str = "42") -> DataFrame:
    """Add ``split``: per class a deterministic share, at least one row, goes to test."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), F.col(key)]
    sizes = items.groupBy(cls).agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_test"))
    return salted_join(ranked(items, order, "_n", [cls]), sizes, [cls], F.col(key)).withColumn(
        "split", F.when(F.col("_n") <= F.col("_test"), "test").otherwise("train")).drop("_n", "_test")
