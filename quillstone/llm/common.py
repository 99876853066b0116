"""Small helpers the operators share."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Runs of Unicode white space with the word after them.  The four separators U+001C-001F are
# white space to Python but not to Unicode, nor to the tokenizers.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

# Rows of a word memo inside one Python worker, and the longest word it keeps.
MEMO_ROWS = 400_000
MEMO_CHARS = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def learned_from(doc_id: str = "doc_id") -> Column:
    """Rows whose label may be learned: crc32 of the id as text leaves a remainder by five."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def groups(texts: list[str], chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Slices of a list of texts that hold about ``chars`` characters each, one text at least."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))


def map_rows(df: DataFrame, per_batch: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with one object per task: ``per_batch()`` is called once, its result per Arrow batch."""

    def run(batches):
        gc.disable()  # rows make no cycles, and passes over large memos cost as much as the work
        handle = per_batch()
        for batch in batches:
            yield handle(batch)

    return df.mapInArrow(run, schema)
