"""Conflict tables: materialise, resolve, view; dedup answers merged with original atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .joins import salted_join
from .ranking import ranked

MERGEABLE = ("duplicate", "minor_variation", "overlap")


def materialise_conflicts(conflicts: DataFrame, atoms: DataFrame, order: str) -> DataFrame:
    """Numbered conflicts with title, source and content length of both atoms; an unknown atom becomes an empty one.

    Contents stay where they are (``with_contents`` fetches them for the rows that show them).
    An atom may be part of any number of conflicts, so its conflicts are spread.
    """
    def side(s: str) -> DataFrame:
        return atoms.select(
            F.col("id").alias(f"{s}_id"), F.col("title").alias(f"_{s}_title"), F.length("content").alias(f"_{s}_length"),
            F.col("source").alias(f"{s}_source"))

    # Numbered while the rows are still narrow.
    numbered = ranked(conflicts, [F.col(order)], "_n").withColumn("conflict_id", F.format_string("conflict_%03d", "_n")).drop("_n")
    joined = numbered
    for s in "ab":
        joined = salted_join(joined, side(s), [f"{s}_id"], F.col("conflict_id"), "left")
    return joined.withColumns({
        **{f"{s}_title": F.coalesce(f"_{s}_title", F.lit("Unknown")) for s in "ab"},
        **{f"{s}_length": F.coalesce(f"_{s}_length", F.lit(0)) for s in "ab"},
        "conflict_type": F.coalesce("conflict_type", F.lit("contradictory_data")),
        "description": F.coalesce("description", F.lit("")),
    }).drop("_a_title", "_a_length", "_b_title", "_b_length")


USES = 10_000  # conflicts that one copy of a text serves


def with_contents(conflicts: DataFrame, atoms: DataFrame) -> DataFrame:
    """Add the contents of both atoms, empty for an unknown one.

    Only texts in use are moved, each once per ``USES`` conflicts that show it.
    """
    conflicts = materialise(conflicts, "conflicts")
    uses = {s: materialise(conflicts.groupBy(f"{s}_id").agg(F.ceil(F.count("*") / USES).cast("int").alias(f"_{s}_parts")), "uses") for s in "ab"}
    # Dealt while the rows are still narrow.
    for s in "ab":
        part = F.pmod(F.xxhash64("conflict_id"), F.col(f"_{s}_parts")).cast("int")
        conflicts = salted_join(conflicts, uses[s], [f"{s}_id"], F.col("conflict_id"), "left").withColumn(f"_{s}_part", part).drop(f"_{s}_parts")
    for s in "ab":
        texts = atoms.select(F.col("id").alias(f"{s}_id"), F.col("content").alias(f"{s}_content")).join(uses[s], f"{s}_id").withColumn(
            f"_{s}_part", F.explode(F.sequence(F.lit(0), F.col(f"_{s}_parts") - 1))).drop(f"_{s}_parts")
        conflicts = conflicts.join(texts, [f"{s}_id", f"_{s}_part"], "left").drop(f"_{s}_part")
    return conflicts.withColumns({f"{s}_content": F.coalesce(f"{s}_content", F.lit("")) for s in "ab"})


def auto_resolve(conflicts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Resolution by evidence, else the longer text for near-identical kinds."""
    kind = F.lower("conflict_type")
    mergeable = kind.contains(MERGEABLE[0])
    for m in MERGEABLE[1:]:
        mergeable = mergeable | kind.contains(m)
    la, lb = F.col("a_length"), F.col("b_length")
    proven = F.coalesce(F.col("claim_verified") & (F.col("claim_confidence") > threshold), F.lit(False))
    by_length = mergeable & (la > 0) & (lb > 0)
    resolution = (
        F.when(proven, "keep_a").when(by_length & (la >= lb), "keep_a").when(by_length, "keep_b").otherwise("pending")
    )
    return conflicts.withColumn("resolution", resolution).withColumn("auto_resolved", F.col("resolution") != "pending")


def rejected(resolved: DataFrame) -> DataFrame:
    """Ids an automatic resolution removes."""
    return resolved.filter("auto_resolved").select(
        F.when(F.col("resolution") == "keep_a", F.col("b_id")).otherwise(F.col("a_id")).alias("id")).distinct()


def review_view(resolved: DataFrame, atoms: DataFrame) -> DataFrame:
    """Conflicts left for a reviewer: content, else title; default sources."""
    def shown(s: str) -> Column:
        return F.coalesce(F.nullif(f"{s}_content", F.lit("")), F.col(f"{s}_title"))

    return with_contents(resolved.filter(~F.col("auto_resolved")), atoms).select(
        "conflict_id", shown("a").alias("atom_a"), shown("b").alias("atom_b"),
        F.coalesce("a_source", F.lit("transcript")).alias("source_a"), F.coalesce("b_source", F.lit("baseline")).alias("source_b"),
        "conflict_type", "description")


def apply_decisions(atoms: DataFrame, decisions: DataFrame) -> DataFrame:
    """keep_a, keep_b, merge and discard over (ord, action, a_id, b_id, merged_content).

    A dropped atom stays dropped, so drops need no order; of several merges
    into one surviving atom the last counts.
    """
    action = F.coalesce("action", F.lit("keep_a"))
    merging = (action == "merge") & (F.length("merged_content") > 0)
    d = decisions.withColumn("_action", action).withColumn("_merge", F.coalesce(merging, F.lit(False)))
    drops = d.select(F.explode(F.filter(F.array(
        F.when(F.col("_action").isin("keep_a", "discard") | F.col("_merge"), F.col("b_id")),
        F.when(F.col("_action").isin("keep_b", "discard"), F.col("a_id")),
    ), lambda x: x.isNotNull())).alias("id")).distinct()
    merges = d.filter("_merge").groupBy(F.col("a_id").alias("id")).agg(F.max_by("merged_content", "ord").alias("_content"))
    kept = atoms.join(drops, "id", "left_anti").join(merges, "id", "left")
    return kept.withColumns({
        "content": F.coalesce("_content", F.col("content")),
        "status": F.when(F.col("_content").isNotNull(), "deduplicated").otherwise(F.col("status")),
    }).drop("_content")


def merge_answers(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Dedup answers per batch joined to the original atoms.

    A batch whose answer keeps nothing or under 30% keeps all its atoms.
    Originals are the truth; merged_from comes from the answer and a longer
    merged content replaces the original.  Unknown ids are new atoms.
    """
    size = batch.groupBy("batch").agg(F.count("*").alias("_n"))
    kept = answers.groupBy("batch").agg(F.count("*").alias("_kept"))
    trusted = size.join(kept, "batch", "left").select(
        "batch", (F.coalesce("_kept", F.lit(0)) >= F.greatest(F.lit(1), F.col("_n") * 0.3)).alias("_ok"))
    a = answers.select("batch", "id", F.col("content").alias("_new"), "merged_from", F.lit(True).alias("_has"))
    joined = batch.join(trusted, "batch").join(a, ["batch", "id"], "left")
    has_merge = F.coalesce(F.size("merged_from") > 0, F.lit(False)) & F.col("_ok")
    longer = has_merge & (F.length("_new") > F.length("content"))
    old = joined.filter(~F.col("_ok") | F.col("_has")).select(
        "batch", "id", F.when(longer, F.col("_new")).otherwise(F.col("content")).alias("content"), "category", "source",
        F.when(has_merge, F.col("merged_from")).alias("merged_from"), F.lit("deduplicated").alias("status"))
    fresh = a.join(batch.select("batch", "id"), ["batch", "id"], "left_anti").join(trusted.filter("_ok"), "batch").select(
        "batch", "id", F.col("_new").alias("content"), F.lit("general").alias("category"), F.lit("transcript").alias("source"),
        "merged_from", F.lit("deduplicated").alias("status"))
    return old.unionByName(fresh)
