"""Upserts, patches, freshness and retention over registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import latest


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace by ``key``: the last row by ``order`` wins."""
    return latest(existing.unionByName(incoming), [key], F.col(order))


def scrape_status(entries: DataFrame, url: str, order: str) -> DataFrame:
    """One row per URL: last scrape, entry count, hash of the first entry."""
    return entries.groupBy(url).agg(
        F.max("last_scraped").alias("last_scraped"),
        F.count("*").alias("entry_count"),
        F.min_by("content_hash", order).alias("content_hash"),
    )


def fresh(urls: DataFrame, status: DataFrame, key: str, now: Column, ttl_hours: int = 168) -> DataFrame:
    """Add ``is_fresh``; a URL without status is stale."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_scraped")
    return urls.join(status.select(key, "last_scraped"), key, "left").withColumn(
        "is_fresh", F.coalesce(age < ttl_hours * 3600, F.lit(False))
    )


def patch(base: DataFrame, changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Overwrite only the columns a change carries; the last non-null change wins."""
    last = changes.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns]
    )
    joined = base.join(last, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns
    ])


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def add_usage(base: DataFrame, uses: DataFrame, key: str, counter: str) -> DataFrame:
    n = uses.groupBy(key).agg(F.count("*").alias("_n"))
    return base.join(n, key, "left").withColumn(
        counter, F.col(counter) + F.coalesce("_n", F.lit(0))
    ).drop("_n")


def expired(builds: DataFrame, now: Column, days: int, created: str, status: str, finished: tuple[str, ...]) -> DataFrame:
    """Finished builds older than ``days``; zero or less disables retention."""
    old = F.col(created) < now - F.expr(f"INTERVAL {max(days, 0)} DAYS")
    return builds.filter(F.col(status).isin(*finished) & old & F.lit(days > 0))


def entries_of(entries: DataFrame, sources: DataFrame, url: str) -> DataFrame:
    """Stored entries of the asked source addresses."""
    return entries.join(sources.select(url).distinct(), url, "left_semi").select(*entries.columns)
