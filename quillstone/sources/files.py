"""File sources and sinks: transcripts, baseline folders, phase artifacts, scraped pages, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as D

from ..functions import constants as K, text as T
from ..operators.cleaning import clean
from ..operators.ranking import ranked

ATOM = D.StructType(
    [D.StructField(n, t) for n, t in (
        ("id", D.StringType()), ("title", D.StringType()), ("content", D.StringType()),
        ("category", D.StringType()), ("tags", D.ArrayType(D.StringType())),
        ("source_video", D.StringType()), ("source_page", D.IntegerType()),
        ("source_timestamp", D.StringType()), ("confidence", D.DoubleType()),
        ("status", D.StringType()), ("verification_note", D.StringType()),
        ("baseline_reference", D.StringType()), ("created_at", D.StringType()),
        ("source", D.StringType()), ("gap_filled", D.BooleanType()),
    )]
)
ATOM_ENVELOPE = D.StructType([
    D.StructField("atoms", D.ArrayType(ATOM)), D.StructField("total_atoms", D.LongType()),
    D.StructField("score", D.DoubleType()),
])
REFERENCE = D.StructType([D.StructField("path", D.StringType()), D.StructField("content", D.StringType()),
                          D.StructField("url", D.StringType()), D.StructField("tokens", D.LongType())])
BASELINE_ENVELOPE = D.StructType([
    D.StructField("source", D.StringType()), D.StructField("domain", D.StringType()),
    D.StructField("skill_md", D.StringType()), D.StructField("references", D.ArrayType(REFERENCE)),
    D.StructField("topics", D.ArrayType(D.StringType())), D.StructField("total_tokens", D.LongType()),
    D.StructField("score", D.DoubleType()),
])
PAGE = D.StructType([
    D.StructField("url", D.StringType()), D.StructField("title", D.StringType()),
    D.StructField("content", D.StringType()),
    D.StructField("headings", D.ArrayType(D.StructType([
        D.StructField("level", D.StringType()), D.StructField("text", D.StringType()),
        D.StructField("id", D.StringType())]))),
    D.StructField("links", D.ArrayType(D.StringType())),
])


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, filename, raw, error): bytes that are no UTF-8 give an error, not a failure."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(path)
    )
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("filename"),
        F.when(valid, text).otherwise("").alias("raw"),
        F.when(~valid, F.lit("not valid UTF-8")).alias("error"),
    )


def read_transcripts(spark: SparkSession, path: str, cleaned: bool = True) -> DataFrame:
    """Transcript files with cleaned content, word count, statistics and read error."""
    raw = _whole_files(spark, path, "*.{txt,md,srt,vtt}")
    out = clean(raw, "raw", "content", enabled=cleaned)
    return out.select("filename", "path", "content", T.word_count(F.col("content")).alias("word_count"),
                      "clean_stats", "error")


def non_empty(transcripts: DataFrame) -> DataFrame:
    return transcripts.filter(F.length("content") > 0)


def read_baseline_folder(spark: SparkSession, path: str) -> DataFrame:
    """References in file-name order with ``ref_idx``; unreadable files are left out."""
    refs = _whole_files(spark, f"{path}/references", "*").filter(F.col("error").isNull())
    return number_references(refs.select("filename", F.col("raw").alias("content")), "filename")


def number_references(refs: DataFrame, name: str) -> DataFrame:
    """Zero-based ``ref_idx`` by name: list order decides ties later on."""
    return ranked(refs, [F.col(name)], "_n").withColumn("ref_idx", F.col("_n") - 1).drop("_n")


def admitted(summaries: DataFrame, need_references: bool = False) -> DataFrame:
    """Baseline summaries from an admitted source."""
    ok = F.col("source").isin(*K.BASELINE_SOURCES)
    return summaries.filter(ok & (F.size("references") > 0) if need_references else ok)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of JSON envelopes; fields outside the schema are dropped."""
    return spark.read.schema(ATOM_ENVELOPE).json(path, multiLine=True).select(F.inline("atoms"))


def read_baseline_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_ENVELOPE).json(path, multiLine=True)


def write_phase(atoms: DataFrame, path: str, build: str = "build_id", fmt: str = "parquet") -> None:
    """One folder per build, so that a finished phase is a folder that exists."""
    atoms.write.mode("overwrite").partitionBy(build).format(fmt).save(path)


def phase_counters(atoms: DataFrame, build: str = "build_id") -> DataFrame:
    """Counters of the envelope, one row per build."""
    return atoms.groupBy(build).agg(
        F.count("*").alias("total_atoms"),
        F.count(F.when(F.col("status").isin("verified", "updated"), 1)).alias("verified"),
        F.count(F.when(F.col("status") == "flagged", 1)).alias("flagged"),
    )


def read_scraped_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scraped pages: a JSON document per file, or with ``lines`` one per line, which splits."""
    return spark.read.schema(PAGE).json(path, multiLine=not lines)


def write_scraped_pages(pages: DataFrame, path: str) -> None:
    """Pages in the nested form of the reader, one JSON document per line."""
    pages.select(*PAGE.fieldNames()).write.json(path)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of a source tree, paths relative to ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    return files.select(
        F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"),
        F.col("content").cast("string").alias("content"),
    )
