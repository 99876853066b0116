"""Topic lookup and claim checks over a table of reference entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .joins import salted_join
from .matching import occurrences, space_tokens


def lookup(topics: DataFrame, key: str, topic: str, entries: DataFrame, ord_: str, searched: Column, limit: int = 5) -> DataFrame:
    """(key, entry ord, position): first ``limit`` entries containing a topic word, in word order.

    While fewer than ``limit`` entries are found at most ``limit - 1`` are
    known, so the first ``2 * limit - 1`` entries of each word decide the
    answer exactly; the index keeps no more.
    """
    words = F.filter(T.words(F.lower(F.col(topic))), lambda w: F.length(w) >= 3)
    asked = topics.select(key, F.posexplode(words).alias("_w", "kw"))
    index = occurrences(asked, entries, ord_, space_tokens(searched))
    w = W.partitionBy("kw").orderBy(ord_)
    short = (
        index.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * limit - 1)
        .groupBy("kw").agg(F.sort_array(F.collect_list(ord_)).alias("_hits"))
    )
    met = salted_join(asked, short, ["kw"], F.col(key))
    per_topic = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_w", "_hits"))).alias("_all"))
    found = F.slice(F.array_distinct(F.flatten(F.transform("_all", lambda x: x["_hits"]))), 1, limit)
    return per_topic.select(key, F.posexplode(found).alias("position", ord_))


def verify_claims(claims: DataFrame, key: str, claim: str, topic: str, entries: DataFrame, ord_: str, searched: Column, content: str) -> DataFrame:
    """Share of the claim's words found in the best of its first three entries."""
    hits = lookup(claims, key, topic, entries, ord_, searched, 3)
    said = F.array_distinct(T.words(F.lower(F.col(claim))))
    scored = (
        hits.join(claims.select(key, said.alias("_said")), key)
    )
    # common words find the same first entries, so an entry may be asked for by any share of the claims
    has = entries.select(ord_, F.array_distinct(T.words(F.lower(F.col(content)))).alias("_has"))
    scored = salted_join(scored, has, [ord_], F.col(key)).select(
        key, ord_, "position", (F.size(F.array_intersect("_said", "_has")) / F.greatest(F.size("_said"), F.lit(1))).alias("_score"))
    best = scored.groupBy(key).agg(F.max_by(
        F.struct(F.col("_score").alias("score"), F.col(ord_).alias("entry")), F.struct("_score", -F.col("position"))).alias("b"))
    shown = entries.select(F.col(ord_).alias("_entry"), F.left(F.col(content), F.lit(500)).alias("_evidence"))
    shown = salted_join(best.select(key, "b", F.col("b.entry").alias("_entry")), shown, ["_entry"], F.col(key))
    score = F.coalesce("b.score", F.lit(0.0))
    return claims.join(shown, key, "left").select(
        *claims.columns,
        (score > 0.3).alias("verified"),
        F.bround(score, 2).alias("confidence"),
        F.when(score > 0, F.col("b.entry")).alias(ord_),
        F.when(score > 0, F.col("_evidence")).otherwise("").alias("evidence"),
        F.when(score > 0.7, "exact").when(score > 0.3, "partial").otherwise("no_match").alias("match_type"),
    )


def lookup_coverage(topics: DataFrame, key: str, topic: str, entries: DataFrame, ord_: str, searched: Column, kws: str) -> DataFrame:
    hits = lookup(topics, key, topic, entries, ord_, searched, 1)
    conf = entries.select(ord_, (F.size(kws) / 10).alias("confidence"))
    return topics.join(hits.join(conf, ord_), key, "left").select(
        *topics.columns,
        F.col(ord_).isNotNull().alias("covered"),
        F.when(F.col(ord_).isNotNull(), 1).otherwise(0).alias("entries_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
