"""Chunks, batches, routes and stream caps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from .joins import salted_join
from .ranking import ranked

CHARS_PER_TOKEN = 4
BATCH = {"dedup": 30, "knowledge": 30, "verify": 10, "code": 5, "embed": 100, "urls": 50}
CAPS = {"gap_atoms": 10, "code_atoms": 15, "code_files": 20, "docs": 10}


def _pack(pieces, size, join, carry):
    """Greedy packing; a new pack starts with what ``carry`` keeps of the last one."""
    packs, open_ = [], ""
    for piece in pieces:
        fits = len(open_) + len(piece) + carry["slack"] <= size
        if fits:
            open_ = f"{open_}{join}{piece}" if open_ else piece
            continue
        if open_:
            packs.append(open_.strip())
        open_ = carry["start"](packs, piece)
        if carry["split"] and len(open_) > size:
            *full, open_ = _pack(re.split(r"(?<=[.!?])\s+", open_), size, " ", _SENTENCES)
            packs.extend(full)
    return [*packs, open_]


_SENTENCES = {"slack": 0, "start": lambda packs, piece: piece, "split": False}


def chunk(text: str, max_tokens: int = 6000, overlap: int = 200) -> list[str]:
    """Chunks of one text: paragraphs packed up to the limit, overlong ones cut at sentences."""
    size, tail = max_tokens * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    if len(text) <= size:
        return [text]

    def start(packs, piece):
        return f"{packs[-1][-tail:]}\n\n{piece}" if packs and tail else piece

    packs = _pack(text.split("\n\n"), size, "\n\n", {"slack": 2, "start": start, "split": True})
    return [p for p in (p.strip() for p in packs) if len(p) > 50]


def chunks(docs: DataFrame, text: str, max_tokens: int = 6000, overlap: int = 200) -> DataFrame:
    """One row per chunk with chunk_index and total_chunks; documents are independent rows.

    A null text is the empty one, which is one empty chunk.
    """
    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t or "", max_tokens, overlap))

    # Texts within the limit never leave the JVM.
    src = F.coalesce(F.col(text), F.lit(""))
    short = docs.filter(F.length(src) <= max_tokens * CHARS_PER_TOKEN).withColumn("_chunks", F.array(src))
    long = docs.filter(F.length(src) > max_tokens * CHARS_PER_TOKEN).withColumn("_chunks", cut(src))
    rest = [c for c in docs.columns if c != text]
    return short.unionByName(long).select(
        *rest, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "chunk"))


def batches(items: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """Add the batch number (from 1) and the place within the batch."""
    n = ranked(items, order, "_n", group)
    return n.withColumns({
        "batch": F.floor((F.col("_n") - 1) / size) + 1, "place": (F.col("_n") - 1) % size}).drop("_n")


def requests(items: DataFrame, group: list[str], order: list[Column], size: int, payload: Column) -> DataFrame:
    """One request row per batch with its payloads in order, at most ``size`` of them."""
    b = batches(items, group, order, size)
    return b.groupBy(*group, "batch").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", payload.alias("p")))), lambda x: x["p"]).alias("payload"))


def route_categories(atoms: DataFrame, category: str, order: str, size: int = 30) -> DataFrame:
    """keep (groups of 1-2), combined (3-14, pooled) or solo (15 and more), with batch numbers."""
    groups = atoms.groupBy(category).agg(F.count("*").alias("_size"), F.min(order).alias("_first"))
    route = F.when(F.col("_size") <= 2, "keep").when(F.col("_size") < 15, "combined").otherwise("solo")
    routed = salted_join(atoms, groups, [category], F.col(order)).withColumn("route", route)
    pool = F.when(F.col("route") == "combined", "").otherwise(F.col(category))
    lead = F.when(F.col("route") == "combined", F.col("_first")).otherwise(F.lit(0))
    out = batches(routed.withColumn("_pool", pool), ["route", "_pool"], [lead, F.col(order)], size)
    return out.withColumn("batch", F.when(F.col("route") != "keep", F.col("batch"))).drop("_size", "_first", "_pool", "place")


def capped(stream: DataFrame, order: list[Column], kind: str) -> DataFrame:
    """First rows of a stream up to the feature's cap."""
    return stream.orderBy(*order).limit(CAPS[kind])
