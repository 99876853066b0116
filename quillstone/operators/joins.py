"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 8
) -> DataFrame:
    """Equi-join with every key of ``big`` spread over ``salts`` tasks.

    ``spread`` is a per-row Column of ``big`` (an id).  ``small`` is repeated
    once per salt; no side is broadcast by hint, AQE does so when the measured
    size allows it.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    right = small.withColumn("_salt", copies)
    return left.join(right, [*on, "_salt"], how).drop("_salt")
