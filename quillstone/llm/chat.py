"""Chat formatting by rotating the perspective.

Each dialogue is rendered once per participant: that speaker's turns are the assistant's and
carry the training mask, all other speakers are users with their names, and context turns
(``system``) stay what they are, unmasked.  The mask covers the assistant's words and the
closing marker that it has to learn.

A rendered dialogue comes in parts of about ``PART_CHARS`` characters, cut between turns, so
no row or group grows with the dialogue; joined in order the parts are the whole.  Where a turn
begins is a running sum over the dialogue, taken over ranges of turns (``running_total``), so a
dialogue with a large share of all rows is spread over many tasks.

Cases: a null role is a speaker named ``unknown``, a null text is empty, a null turn comes
first and null ids are one dialogue; turns that share a number are ordered by speaker and text,
repeated rows are repeated turns; a dialogue of context turns alone has no participant and
gives no rows; markers inside texts stay as they are, since masks are offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import running_total

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
PART_CHARS = 1 << 20


def segments(conversations: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Per turn and perspective: ``conv_id, perspective, turn, segment, start, stop, mask_start, mask_stop``."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
    )
    people = turns.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    name = F.when(F.col("speaker").isin(*context), F.col("speaker")).when(own, "assistant").otherwise(F.concat(F.lit("user name="), "speaker"))
    head = F.concat(F.lit(OPEN), name, F.lit("\n"))
    drawn = seen.select(
        "conv_id", "perspective", "turn", "speaker", F.md5("text").alias("_md5"), own.alias("_own"),
        F.length(head).alias("_head"), F.concat(head, "text", F.lit(f"{CLOSE}\n")).alias("segment"),
    )
    order = [F.col("turn"), F.col("speaker"), F.col("_md5")]
    placed = running_total(drawn, order, F.length("segment").cast("long"), "stop", ("conv_id", "perspective"))
    start = F.col("stop") - F.length("segment")
    return placed.select(
        "conv_id", "perspective", "turn", "segment", start.alias("start"), "stop",
        F.when(F.col("_own"), start + F.col("_head")).alias("mask_start"), F.when(F.col("_own"), F.col("stop") - 1).alias("mask_stop"),
    )


def rotate(conversations: DataFrame, part_chars: int = PART_CHARS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Per perspective and part: ``conv_id, perspective, part, n_turns, text, masks``.

    ``masks`` lists ``start:end`` in code points of the whole rendering, ends exclusive.
    """
    rows = segments(conversations, context).withColumn("part", F.floor(F.col("start") / part_chars).cast("long"))
    turns = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_stop")))
    parts = rows.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n_turns"), turns.alias("turns"))
    masks = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()), lambda t: F.concat_ws(":", t["mask_start"], t["mask_stop"]))
    return parts.select(
        "conv_id", "perspective", "part", "n_turns", F.array_join(F.col("turns.segment"), "").alias("text"), F.array_join(masks, ",").alias("masks")
    )


ROTATE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, md5(text) AS h, speaker = perspective AS own,
         '{OPEN}' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                          ELSE 'user name=' || speaker END || chr(10) AS head, text
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, head || text || '{CLOSE}' || chr(10) AS segment,
         sum(length(head || text || '{CLOSE}' || chr(10))) OVER (
           PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, h ROWS UNBOUNDED PRECEDING) AS stop
  FROM s
), q AS (
  SELECT *, stop - length(segment) AS start FROM r
)
SELECT conv_id, perspective, CAST(start // {PART_CHARS} AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(segment, '' ORDER BY start) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(start + length(head) AS BIGINT) || ':' || CAST(stop - 1 AS BIGINT) END, ',' ORDER BY start), '') AS masks
FROM q GROUP BY conv_id, perspective, start // {PART_CHARS}
"""
