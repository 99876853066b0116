"""Quality: learned hashed word and character n-gram vectors, averaged, under a softmax (see ``subword``).

Case and punctuation stay, since they tell junk apart; windows of three words are in the bag
by their form, which shows repetition with words never seen.  Only labels whose id passes
``learned_from`` are learned.  Labels, language, source and id never enter a score.

Cases: as in ``toxicity``: null and empty texts get the score of the bias alone, texts are
read whole, repeated rows repeat, a null id has a null ``held_out``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import subword, toxicity

#: The sample that is fitted holds this many labelled documents at most.
SAMPLE_ROWS = 4_000
SETTINGS = subword.Settings(buckets=1 << 18, dims=4, epochs=6, rate=0.2, scale=16.0, lower=False, shapes=True)
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, settings: subword.Settings = SETTINGS) -> subword.Margins:
    return subword.learn(docs, labels, "quality", rows, settings)


def score(docs: DataFrame, margins: subword.Margins, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    return toxicity.score(docs, margins, threshold)
