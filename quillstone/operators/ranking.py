"""Ranking without a single-task sort.

``row_number() over (order by ...)`` sends a whole table (or a whole hot
group) to one task.  ``ranked`` splits the key range first: a bounded,
deterministic sample of keys gives range bounds, each (group, range) is ranked
on its own, and the row counts of the lower ranges are added as an offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import bisect


def _bounds(df: DataFrame, key: Column, ranges: int) -> DataFrame:
    """One value: sorted array of at most ``ranges`` keys, the same on every run."""
    slots = (
        df.select(key.alias("k"))
        .groupBy(F.pmod(F.xxhash64("k"), F.lit(ranges)).alias("slot"))
        .agg(F.min_by("k", F.xxhash64("k", F.lit(7))).alias("k"))
    )
    return slots.agg(F.array_sort(F.collect_list("k")).alias("bounds"))


def ranked(
    df: DataFrame,
    order: list[Column],
    name: str = "rn",
    within: tuple[str, ...] | list[str] = (),
    ranges: int = 255,
) -> DataFrame:
    """1-based position by ascending ``order`` (unique per group), per ``within`` group.

    A group may hold any share of the rows: it is spread over the ranges.
    """
    within = list(within)
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.withColumn("_key", key)
    bounds = _bounds(keyed, F.col("_key"), ranges)
    placed = (
        keyed.withColumn("bounds", bounds.scalar())
        .withColumn("_range", bisect(F.col("bounds"), F.col("_key"), ranges))
        .drop("bounds")
    )
    spots = [*within, "_range"]
    # At most ``ranges + 1`` rows per group reach this window.
    lower = (
        W.partitionBy(*[F.col(c) for c in within] if within else [F.lit(0)])
        .orderBy("_range")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*spots)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .drop("_n")
    )
    here = W.partitionBy(*spots).orderBy("_key")
    local = placed.withColumn("_at", F.row_number().over(here))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in within]
    cond = F.col("l._range") == F.col("r._range")
    for s in same:
        cond = cond & s
    joined = local.alias("l").join(offsets.alias("r"), cond)
    return joined.select(
        "l.*", (F.col("r._before") + F.col("l._at")).cast("long").alias(name)
    ).drop("_key", "_range", "_at")


def running_total(
    df: DataFrame, order: list[Column], amount: Column, name: str, within: tuple[str, ...] = (),
    ranges: int = 255,
) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order``; same splitting as ``ranked``."""
    within = list(within)
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.withColumn("_key", key).withColumn("_amount", amount)
    bounds = _bounds(keyed, F.col("_key"), ranges)
    placed = (
        keyed.withColumn("bounds", bounds.scalar())
        .withColumn("_range", bisect(F.col("bounds"), F.col("_key"), ranges))
        .drop("bounds")
    )
    spots = [*within, "_range"]
    lower = (
        W.partitionBy(*[F.col(c) for c in within] if within else [F.lit(0)])
        .orderBy("_range")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*spots)
        .agg(F.sum("_amount").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(lower), F.lit(0)))
        .drop("_s")
    )
    here = W.partitionBy(*spots).orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.withColumn("_at", F.sum("_amount").over(here))
    cond = F.col("l._range") == F.col("r._range")
    for c in within:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return (
        local.alias("l")
        .join(offsets.alias("r"), cond)
        .select("l.*", (F.col("r._before") + F.col("l._at")).alias(name))
        .drop("_key", "_range", "_at", "_amount")
    )


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row per key by ``order``; an aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def exact_sample(df: DataFrame, id_col: str, size: Column, seed: str = "42") -> DataFrame:
    """Deterministic sample of exactly ``size`` rows (a one-row scalar Column), by seeded hash."""
    order = [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))), F.col(id_col)]
    return ranked(df, order, "_pick").filter(F.col("_pick") <= size).drop("_pick")
