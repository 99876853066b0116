"""Typing, streams and ids of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, text as T
from .ranking import ranked


def category_or_general(c: Column) -> Column:
    return F.when(F.length(T.strip(F.coalesce(c, F.lit("")))) == 0, "general").otherwise(c)


def is_generic_domain(c: Column) -> Column:
    name = T.strip(F.lower(c))
    return name.isin(*K.GENERIC_DOMAINS) | (F.length(name) <= 3)


def typed(raw: DataFrame, stream: str) -> DataFrame:
    """Defaults per field for one stream: transcript, gap or code."""
    confidence = 0.5 if stream == "transcript" else 0.85
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    content = F.coalesce("content", F.lit(""))
    category = category_or_general(F.col("category"))
    if stream == "code":
        content = F.when(
            F.length("code_snippet") > 0, F.concat(content, F.lit("\n\n```\n"), "code_snippet", F.lit("\n```"))
        ).otherwise(content)
        tags = F.concat(tags, F.array(F.lit("code"), F.coalesce("pattern_type", F.lit("general"))))
        category = F.lit("code_pattern")
    source = {"transcript": "transcript", "gap": "baseline", "code": "codebase"}[stream]
    return raw.withColumns({
        "title": F.coalesce("title", F.lit("Untitled")),
        "content": content,
        "category": category,
        "tags": tags,
        "confidence": F.coalesce("confidence", F.lit(confidence)),
        "status": F.lit("raw"),
        "source": F.lit(source),
        "gap_filled": F.lit(stream == "gap"),
    })


def union_streams(transcript: DataFrame, gap: DataFrame, code: DataFrame) -> DataFrame:
    """One table in stream order."""
    parts = [d.withColumn("stream", F.lit(i)) for i, d in enumerate((transcript, gap, code))]
    return parts[0].unionByName(parts[1], True).unionByName(parts[2], True)


def sequential_ids(df: DataFrame, order: list[Column], prefix: str = "atom", width: int = 4, out: str = "id") -> DataFrame:
    """prefix_0001.. along ``order``, without a single-task sort."""
    numbered = ranked(df, order, "_n")
    return numbered.withColumn(out, F.format_string(f"{prefix}_%0{width}d", F.col("_n"))).drop("_n")


def taxonomy(spark) -> DataFrame:
    """(taxonomy, category, ord, subcategories): the fixed dimension, 18 rows."""
    rows = [
        (name, cat, i, subs.split())
        for name, cats in K.TAXONOMY.items() for i, (cat, subs) in enumerate(cats.items())
    ]
    return spark.createDataFrame(rows, "taxonomy string, category string, ord int, subcategories array<string>")


def taxonomy_name(domain: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in K.DOMAIN_ALIASES.items() for x in kv])
    name = F.coalesce(alias[domain], domain)
    return F.when(name.isin(*K.TAXONOMY), name).otherwise("custom")
