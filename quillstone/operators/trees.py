"""Source-tree classification, ranking and profiles over a table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from .joins import salted_join
from .urls import top_rows


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def _suffix(path: Column) -> Column:
    """Extension with its dot; a leading dot alone is no extension."""
    return F.regexp_extract(_name(path), r"^.+(\.[^.]+)\z", 1)


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, label in reversed(K.LANGUAGES.items()):
        out = F.when(_suffix(path) == suffix, label).otherwise(out)
    return out


def classify(files: DataFrame, tree: str, path: str) -> DataFrame:
    """Add ``kind`` (readme, config, doc, test, source or other) and ``language``.

    Ignored folders and files are dropped.  Only the first read-me of a tree
    (by path) is its ``readme``; later ones are ``other``.
    """
    p = F.col(path)
    parent = F.regexp_replace(p, r"/?[^/]*\z", "")
    kept = files.filter(
        ~F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(d) for d in K.IGNORED_DIRS]))
        & ~_name(p).isin(*K.IGNORED_FILES)
    )
    is_source = _suffix(p).isin(*K.LANGUAGES)
    kind = (
        F.when(F.lower(_name(p)).startswith("readme"), "readme")
        .when(_name(p).isin(*K.CONFIG_FILES), "config")
        .when(F.lower(parent).contains("doc") & _suffix(p).isin(*K.DOC_SUFFIXES), "doc")
        .when(F.lower(p).contains("test") & is_source, "test")
        .when(is_source, "source")
        .otherwise("other")
    )
    typed = kept.withColumn("kind", kind)
    first = (
        typed.filter(F.col("kind") == "readme").groupBy(tree).agg(F.min(path).alias("_readme"))
    )
    return salted_join(typed, first, [tree], F.col(path), "left").select(
        *files.columns,
        F.when((F.col("kind") == "readme") & (p != F.col("_readme")), "other").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind") == "source", language(p)).alias("language"),
    )


def importance(path: Column, size: Column) -> Column:
    entry = F.lit(False)
    for e in K.ENTRY_POINTS:
        entry = entry | path.endswith(e)
    depth = F.regexp_count(path, F.lit("/"))
    return (
        F.when(entry, 100).otherwise(0)
        + F.greatest(F.lit(0), 10 - depth) * 5
        + F.least(F.floor(size / 1000), F.lit(20)).cast("int")
    )


def top_sources(classified: DataFrame, tree: str, path: str, size: str, k: int = 20) -> DataFrame:
    scored = classified.filter(F.col("kind") == "source").withColumn(
        "score", importance(F.col(path), F.col(size))
    )
    return top_rows(scored, [tree], [F.col("score").desc(), F.col(path)], k, "rank")


def profile(classified: DataFrame, tree: str, path: str) -> DataFrame:
    """One row per tree: file counts, languages, primary language, first five config files."""
    per_language = (
        classified.filter(F.col("language").isNotNull())
        .groupBy(tree, "language")
        .agg(F.count("*").alias("n"), F.min(path).alias("first"))
        .groupBy(tree)
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"),
            # Most files, then the language met first.
            F.min_by("language", F.struct((-F.col("n")).alias("n"), "first")).alias("primary_language"),
        )
    )
    config = (
        top_rows(classified.filter(F.col("kind") == "config"), [tree], [F.col(path)], 5)
        .groupBy(tree)
        .agg(F.sort_array(F.collect_list(path)).alias("config_files"))
    )
    totals = classified.groupBy(tree).agg(
        F.count("*").alias("total_files"),
        F.max(F.col("kind") == "test").alias("has_tests"),
        F.max(F.col("kind") == "doc").alias("has_docs"),
    )
    return (
        totals.join(per_language, tree, "left").join(config, tree, "left")
        .withColumn("primary_language", F.coalesce("primary_language", F.lit("unknown")))
    )


def limit_content(c: Column, limit: int = 10000) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("\n\n# ... (truncated)"))
    ).otherwise(c)


