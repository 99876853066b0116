"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers, ``floor(64 x)``.  Vectors are dealt into index blocks.  In a block the
posting list of every dimension is cut into segments by the size of the component, its
*impact*, quantised into ``LEVELS`` classes; all segments of the highest class come first, then
the next class.  A query block adds up one class of segments after the other.  After each,
what a vector can still gain or lose is at most the query's norm times the norm of the
vector's postings not yet read; from these bounds the k-th best sure score follows, and a
vector whose best possible score is below it is out.  Reading stops when the proof leaves few
possible members (or nothing is left to read), and these are scored exactly in integers.
Blocks are independent; their results meet in a ranked window with a limit before the shuffle.

The stated queries meet each index block once, by an equi-join on the block's number: query
blocks are repeated per index block, packed, and an index block is read by the tasks it goes to.

Cases: null vectors and those with null or non-finite components take no part, nor do vectors
with a component of 2**26 or more after scaling, whose scores would leave the exact range;
of vectors of different lengths the missing components count as zero; equal scores go to the
smaller id; rows that repeat a (id, vector) are one; ids that repeat with other vectors are
rows of their own, and a query never returns its own id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .common import map_rows

SCALE = 64
LIMIT = 1 << 26
BLOCK = 4096
QUERY_BLOCK = 256
SHARES = (0.15, 0.35, 0.6, 1.0)  # of a block's postings read up to the end of each impact class
LEVELS = len(SHARES)
FEW = 0.02  # stop reading when this share of the (query, vector) pairs is still possible


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, q`` (array of int) of the vectors that take part, each once."""
    x = F.col(embedding)
    wide = F.transform(x, lambda c: c.cast("double"))
    sound = x.isNotNull() & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / SCALE)) & F.col(vec_id).isNotNull()
    ints = F.transform(wide, lambda c: F.floor(c * SCALE).cast("int"))
    return vectors.filter(sound).select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("q")).distinct()


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def postings(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a block by descending impact class: (dimension, local row, value), and where each class ends."""
    local, dim = np.nonzero(block)
    value = block[local, dim]
    impact = np.abs(value)
    order = np.argsort(-impact, kind="stable")
    cut = [0, *(int(len(order) * s) for s in SHARES)]
    parts = [np.sort(order[a:b]) for a, b in zip(cut, cut[1:])]
    order = np.concatenate(parts) if parts else order
    return dim[order].astype(np.int32), local[order].astype(np.int32), value[order].astype(np.int32), np.array(cut[1:], np.int64)


def index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per index block: ids, width, and the packed postings."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        width = max(map(len, pdf["q"]), default=0)
        block = matrix(list(pdf["q"]), width)
        dim, local, value, ends = postings(block)
        ids = pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame({
            "block": [int(pdf["block"].iloc[0])], "width": [width], "ids": [ids.tobytes()], "dims": [dim.tobytes()],
            "locals": [local.tobytes()], "values": [value.tobytes()], "ends": [ends.tobytes()],
        })

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int"))
    schema = "block int, width int, ids binary, dims binary, locals binary, values binary, ends binary"
    return dealt.groupBy("block").applyInPandas(pack, schema)


def best(queries: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, width: int, dim, local, value, ends, k: int):
    """(query row, vector row, score) of the block's k best for each query, ties to the smaller id."""
    n, w = len(ids), max(width, queries.shape[1])
    block = np.zeros((n, w), np.int64)
    block[local, dim] = value
    wide = np.zeros((len(queries), w), np.int64)
    wide[:, : queries.shape[1]] = queries
    q_norm = np.sqrt((wide.astype(float) ** 2).sum(axis=1))
    left = (block.astype(float) ** 2).sum(axis=1)
    exact32 = q_norm.max(initial=0) * np.sqrt(left.max(initial=0)) < 1 << 22
    kind = np.float32 if exact32 else np.float64
    wq = wide.astype(kind)
    slack = 1.0 + 1e-9 * q_norm[:, None] * np.sqrt(left.max(initial=0))
    sums = np.zeros((len(queries), n), kind)
    own = q_ids[:, None] == ids[None, :]
    possible = ~own
    start = 0
    for level, end in enumerate(ends.tolist()):
        plane = np.zeros((n, w), kind)
        plane[local[start:end], dim[start:end]] = value[start:end]
        sums += wq @ plane.T
        left = left - (plane.astype(float) ** 2).sum(axis=1)
        start = end
        gap = (q_norm[:, None] * np.sqrt(np.maximum(left, 0))[None, :] + slack).astype(kind)
        if n > k + 1:
            sure = np.where(own, -np.inf, sums - gap)
            kth = np.partition(sure, n - k, axis=1)[:, n - k]
            possible = ~own & (sums + gap >= kth[:, None])
        if level + 1 < len(ends) and possible.mean() <= FEW:
            break
    out = []
    for i in range(len(queries)):
        rows = np.flatnonzero(possible[i])
        scores = block[rows] @ wide[i]  # in integers
        top = np.lexsort((ids[rows], -scores))[:k]
        out.append((np.full(len(top), i), rows[top], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query and rank: ``query_id, rank, vec_id, score``; both inputs have ``vec_id, q``."""
    count = vectors.count()
    blocks = max(1, -(-count // BLOCK))
    packed = materialise(index(vectors, blocks), "impact-index")
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["q"]), default=0)
        return pd.DataFrame({
            "q_width": [width], "q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q_values": [matrix(list(pdf["q"]), width).tobytes()],
        })

    dealt = queries.groupBy(F.pmod(F.xxhash64("vec_id", "q"), F.lit(q_blocks)).alias("q_block"))
    asked = dealt.applyInPandas(pack, "q_width int, q_ids binary, q_values binary")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")

    def start():
        def handle(batch):
            found = []
            for r in batch.to_pylist():
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                ids = np.frombuffer(r["ids"], np.int64)
                wide = np.frombuffer(r["q_values"], np.int32).reshape(len(q_ids), r["q_width"])
                parts = (np.frombuffer(r[c], np.int32) for c in ("dims", "locals", "values"))
                i, j, score = best(wide, q_ids, ids, r["width"], *parts, np.frombuffer(r["ends"], np.int64), k)
                found.append((q_ids[i], ids[j], score))
            made = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
            return pa.record_batch([pa.array(x.astype(np.int64)) for x in made], names=["query_id", "vec_id", "score"])

        return handle

    local = map_rows(pairs, start, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
