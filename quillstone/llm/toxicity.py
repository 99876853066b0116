"""Toxicity: averaged subword embeddings under a linear softmax (see ``subword``).

Lower-cased words; a misspelt word keeps most of the n-grams of the word it hides.
Only labels whose id passes ``learned_from`` are learned.  Labels, language, source and id
never enter a score.

Cases: null and empty texts get the score of the bias alone; long texts are read whole;
rows are scored one by one, so repeated rows repeat; null ids pass through, with ``held_out``
null.  Without labels of both kinds every score is the share of label 1.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import subword
from .common import learned_from, map_rows, whole_text

#: The sample that is fitted holds this many labelled documents at most.
SAMPLE_ROWS = 8_000
SETTINGS = subword.Settings(buckets=1 << 19, dims=4, epochs=10, rate=0.25, scale=32.0, damping=1e-3)
THRESHOLD = 0.5


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, settings: subword.Settings = SETTINGS) -> subword.Margins:
    return subword.learn(docs, labels, "toxic", rows, settings)


def with_score(docs: DataFrame, margins: subword.Margins, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the score as a further column ``name``."""
    held = "_text" + "_" * max(map(len, docs.columns))  # no column's name
    shipped = docs.sparkSession.sparkContext.broadcast(margins)  # settings and one number per slot

    def start():
        scorer = subword.scorer(shipped)

        def handle(batch):
            scores = pa.array(map(scorer.score, batch.column(held).to_pylist()), pa.float64())
            rest = [n for n in batch.schema.names if n != held]
            return pa.record_batch([*[batch.column(n) for n in rest], scores], names=[*rest, name])

        return handle

    rows = docs.withColumn(held, whole_text(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(rows, start, f"{kept}, `{name}` double")


def score(docs: DataFrame, margins: subword.Margins, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), margins, "score")
    return scored.select(
        "doc_id", (~learned_from()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accept(docs: DataFrame, margins: subword.Margins, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns."""
    names = docs.columns
    free = "_toxicity" + "_" * max(map(len, names), default=0)
    return with_score(docs, margins, free).filter(F.col(free) < threshold).select(*[F.col(f"`{n}`") for n in names])
