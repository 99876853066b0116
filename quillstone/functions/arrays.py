"""Array building blocks that keep per-document work inside one row.

A document's lines, tokens or keywords fit in the row they came from, so the
functions here avoid a shuffle per document: no explode, no window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(arr: Column) -> Column:
    """0..n-1, empty for an empty array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def runs(values: Column) -> Column:
    """Distinct values with count and first position: array<struct<n, pos, v>>.

    Sorts (value, position) pairs and measures run lengths, O(n log n).
    """
    pairs = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("pos"))))

    def measure(s: Column) -> Column:
        starts = F.filter(
            indices(s), lambda i: (i == 0) | (F.get(s, i)["v"] != F.get(s, i - 1)["v"])
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda at, j: F.struct(
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - at).alias("n"),
                    F.get(s, at)["pos"].alias("pos"),
                    F.get(s, at)["v"].alias("v"),
                ),
            ),
        )

    return let(pairs, measure)


def top_by_count(values: Column, k: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """The ``k`` most frequent values; equal counts keep first-occurrence order.

    ``keep`` filters distinct values, after counting, so it runs once per value.
    """
    found = runs(values)
    if keep is not None:
        found = F.filter(found, lambda r: keep(r["v"]))
    ranked = F.sort_array(
        F.transform(found, lambda r: F.struct((-r["n"]).alias("n"), r["pos"], r["v"]))
    )
    return F.transform(F.slice(ranked, 1, k), lambda r: r["v"])


def repeated(values: Column, times: int) -> Column:
    """Distinct values that occur at least ``times`` times."""
    return let(
        F.sort_array(values),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + (times - 1)))),
    )


def bisect(bounds: Column, key: Column, size: int) -> Column:
    """How many of the sorted ``bounds`` (at most ``size``) are <= ``key``."""
    steps, step = [], 1
    while step <= size:
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at),
    )
