"""Substring matching of keywords in texts, as equi-joins.

A keyword holds no separator, so wherever it occurs in a text it lies inside
one token of that text.  Tokens are cut into short grams; a keyword meets only
the tokens that carry its leading gram, which needs no cross join and, for
keywords up to the gram length, no check afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays, text as T
from .joins import salted_join

SHORTEST, GRAM, BLOCK = 3, 8, 512


def _grams(tok: Column) -> Column:
    """Distinct substrings of length 3..8; linear in the token's length."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(tok) - SHORTEST + 1, F.lit(1)))
    sizes = F.array(*[F.lit(n) for n in range(SHORTEST, GRAM + 1)])
    cut = F.flatten(F.transform(
        starts,
        lambda s: F.transform(F.filter(sizes, lambda n: s + n - 1 <= F.length(tok)), lambda n: F.substring(tok, s, n)),
    ))
    return F.array_distinct(cut)


def token_pairs(needles: DataFrame, tokens: DataFrame) -> DataFrame:
    """(kw, tok) for every distinct keyword and every distinct token that contains it."""
    keys = needles.select("kw").distinct().withColumn("gram", F.left("kw", F.lit(GRAM)))
    grams = tokens.select("tok").distinct().select("tok", F.explode(_grams(F.col("tok"))).alias("gram"))
    met = keys.join(grams, "gram")
    return met.filter((F.length("kw") <= GRAM) | (F.instr(F.col("tok"), F.col("kw")) > 0)).select("kw", "tok")


def occurrences(needles: DataFrame, texts: DataFrame, ref: str, toks: Column) -> DataFrame:
    """Distinct (kw, ref): which texts contain which keyword."""
    per_ref = texts.select(ref, F.explode(F.array_distinct(toks)).alias("tok"))
    return token_pairs(needles, per_ref).join(per_ref, "tok").select("kw", ref).distinct()


def blocked(index: DataFrame, ref: str) -> DataFrame:
    """One row per (kw, block of 512 references) with the references in an array."""
    return index.groupBy("kw", F.floor(F.col(ref) / BLOCK).alias("block")).agg(
        F.collect_list(ref).alias("refs")
    )


def best_reference(items: DataFrame, key: str, kws: str, refs: DataFrame, ref: str, toks: Column) -> DataFrame:
    """(key, n, ref): the reference with most of the item's keywords, ties to the lower ``ref``.

    Items that match nothing have no row.  Rows per item: at most its number
    of keywords times the number of blocks, whatever the number of references.
    """
    long = items.select(key, F.explode(kws).alias("kw"))
    index = blocked(occurrences(long, refs, ref, toks), ref)
    met = salted_join(long, index, ["kw"], F.col(key))
    per_block = met.groupBy(key, "block").agg(F.flatten(F.collect_list("refs")).alias("refs"))
    top = F.array_min(F.transform(
        arrays.runs(F.col("refs")), lambda r: F.struct((-r["n"]).alias("n"), r["v"].alias("ref"))
    ))
    best = per_block.select(key, top.alias("top")).groupBy(key).agg(F.min("top").alias("top"))
    return best.select(key, (-F.col("top.n")).alias("n"), F.col("top.ref").alias(ref))


def matched_keywords(kws: Column, text: Column) -> Column:
    return arrays.let(F.lower(text), lambda low: F.filter(kws, lambda k: F.instr(low, k) > 0))


def word_tokens(text: Column) -> Column:
    return T.tokens(text, SHORTEST)


def space_tokens(text: Column) -> Column:
    """Whitespace tokens, for needles that may hold punctuation."""
    return F.filter(T.words(F.lower(text)), lambda w: F.length(w) >= SHORTEST)
