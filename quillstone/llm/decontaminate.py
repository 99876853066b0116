"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words.  A *seed* is a run of ``MIN_MATCH`` words hashed by a running
Karp-Rabin product.  Documents and benchmark items that share a seed are joined on it; then,
for each pair, the longest common run of free words is marked in both, again and again, until
none of ``MIN_MATCH`` words is left.  An item is leaked if its marked words reach
``THRESHOLD`` of it.  As tiles may lie in any order, a passage whose sentences were moved is
found like a straight copy.

How it is laid out: seeds of the benchmark set bits of a bitmap of fixed size (an aggregate;
128 pieces of 4 kB, whatever the benchmark's size).  Each document is read once, where it
lies; only the stretches of words whose seeds hit the bitmap leave the task.  Every common
run of ``MIN_MATCH`` words lies inside such a stretch, so these stand for the document from
then on.  The seed join is a plain equi-join of narrow rows, which adaptive execution splits
where one passage is copied very often; the pairs' words are joined by id after that.

Cases: null and empty texts have no words and match nothing; items of fewer than ``MIN_MATCH``
words cannot be told from chance and take no part; a repeated or equal document gives the
same result, each row its own; documents are taken by their words' digest, so null ids work
too; an item id that repeats is one item for each different text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import MEMO_CHARS, MEMO_ROWS, map_rows, whole_text

MIN_MATCH = 5
THRESHOLD = 0.5
BITS = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that products keep all bits
WORD = re.compile(r"\w+")


class Reader:
    """Word hashes of texts, with a memo of frequent words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        memo = self.memo
        new = set(words).difference(memo)
        for w in new:
            memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > MEMO_ROWS:
            memo.clear()
        else:
            for w in new:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        return out


_READER = Reader()


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value of every window of ``length`` words."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    value = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        value = value * BASE + words[i : len(words) - length + 1 + i]
    return value ^ (value >> np.uint64(31))


def tile(doc: list[np.ndarray], item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item by a document's stretches: (stretch, item start, length) of each tile.

    Lengths are tried from the longest that fits downwards; for each, windows of free words on
    both sides are matched by their running hash, compared word by word, and marked.  Ties go
    to the earliest place in the document, then in the item.
    """
    free_item = np.ones(len(item), bool)
    free_doc = [np.ones(len(d), bool) for d in doc]
    tiles = []
    length = longest(doc, free_doc, item, free_item, least)
    while length >= least:
        at_item: dict[int, list[int]] = {}
        for j, h in enumerate(windows(item, length).tolist()):
            if free_item[j : j + length].all():
                at_item.setdefault(h, []).append(j)
        for k, d in enumerate(doc):
            for i, h in enumerate(windows(d, length).tolist()):
                if h in at_item and free_doc[k][i : i + length].all():
                    for j in at_item[h]:
                        if free_item[j : j + length].all() and (d[i : i + length] == item[j : j + length]).all():
                            free_doc[k][i : i + length] = False
                            free_item[j : j + length] = False
                            tiles.append((k, j, length))
                            break
        length = min(length - 1, longest(doc, free_doc, item, free_item, least))
    return tiles


def longest(doc, free_doc, item, free_item, least: int) -> int:
    """Length of the longest common run of free words, 0 if under ``least``."""
    best = 0
    sides = [(d, f) for d, f in zip(doc, free_doc)]

    def shared(n: int) -> bool:
        have = set(windows(item, n)[runs_free(free_item, n)].tolist())
        return bool(have) and any(not have.isdisjoint(windows(d, n)[runs_free(f, n)].tolist()) for d, f in sides)

    low, high = least, len(item)  # a common run of n words has common runs of all shorter lengths
    while low <= high:
        middle = (low + high) // 2
        if shared(middle):
            best, low = middle, middle + 1
        else:
            high = middle - 1
    return best


def runs_free(free: np.ndarray, n: int) -> np.ndarray:
    """Where windows of ``n`` words are wholly free."""
    if len(free) < n:
        return np.zeros(0, bool)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[n:] == taken[:-n]


def item_words(items: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    """item_id, words (array of hashes), seeds (array), one row per different item."""

    def start():
        def handle(batch):
            words = [_READER.words(t) for t in batch.column("_text").to_pylist()]
            seeds = [np.unique(windows(w, least)).view(np.int64) for w in words]
            return pa.record_batch(
                [batch.column("item_id"), lists([w.view(np.int64) for w in words]), lists(seeds)], names=["item_id", "words", "seeds"]
            )

        return handle

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), whole_text(text).alias("_text"))
    return map_rows(rows, start, "item_id long, words array<long>, seeds array<long>").filter(F.size("seeds") > 0).distinct()


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*arrays, np.zeros(0, np.int64)]))


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the benchmark's seeds: at most ``BITS / 32768`` pieces of 4 kB reach the driver."""
    slot = F.pmod(F.col("seed"), F.lit(BITS)) + 1
    pieces = (
        seeds.groupBy(F.bitmap_bucket_number(slot).alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    out = np.zeros(BITS // 8, np.uint8)
    for piece, bits in pieces:
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, np.uint8)
    return out


def stretches(docs: DataFrame, bits: np.ndarray, least: int, text: str) -> DataFrame:
    """Per different text with a hit: its digest, the stretches of words under seeds that hit, and those seeds."""
    shipped = docs.sparkSession.sparkContext.broadcast(bits)  # 512 kB

    def start():
        bits = shipped.value

        def handle(batch):
            keys, words_out, seeds_out = [], [], []
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                words = _READER.words(t)
                values = windows(words, least)
                slot = values & np.uint64(BITS - 1)
                hit = bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                # seeds less than a seed apart share words and lie in one stretch, so no word is in two
                starts = np.flatnonzero(np.diff(at, prepend=at[0] - least) >= least)
                ends = np.append(starts[1:], len(at)) - 1
                keys.append(key)
                words_out.append([words[at[a] : at[b] + least].view(np.int64) for a, b in zip(starts, ends)])
                seeds_out.append(np.unique(values[at]).view(np.int64))
            counts = np.concatenate([[0], np.cumsum([len(w) for w in words_out], dtype=np.int64)]).astype(np.int32)
            nested = pa.ListArray.from_arrays(counts, lists([w for ws in words_out for w in ws]))
            return pa.record_batch([pa.array(keys, pa.string()), nested, lists(seeds_out)], names=["_key", "stretches", "seeds"])

        return handle

    rows = docs.select(key(text).alias("_key"), whole_text(text).alias("_text"))
    return map_rows(rows, start, "_key string, stretches array<array<long>>, seeds array<long>")


def key(text: str = "text"):
    return F.sha2(whole_text(text).cast("binary"), 256)


def overlaps(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: int = MIN_MATCH,
) -> DataFrame:
    """Per pair of a different text and an item that share a seed: ``_key, item_id, n_tiles, longest, matched, item_words, coverage``."""
    bench = materialise(item_words(items, item_id, item_text, least), "bench-words")
    seeds = bench.select("item_id", F.xxhash64("words").alias("_item"), F.explode("seeds").alias("seed"))
    hits = materialise(stretches(docs, bitmap(seeds.select("seed")), least, text).dropDuplicates(["_key"]), "bench-hits")
    pairs = (
        hits.select("_key", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("_key", "item_id", "_item")
        .agg(F.count("*").alias("_n"))
        .drop("_n")
    )
    both = pairs.join(hits.select("_key", "stretches"), "_key").join(
        bench.select(F.col("item_id").alias("_id"), F.xxhash64("words").alias("_item_r"), "words"),
        F.col("_id").eqNullSafe(F.col("item_id")) & (F.col("_item_r") == F.col("_item")),
    )

    def start():
        def handle(batch):
            out = []
            for parts, words in zip(batch.column("stretches").to_pylist(), batch.column("words").to_pylist()):
                item = np.array(words, np.int64).view(np.uint64)
                tiles = tile([np.array(p, np.int64).view(np.uint64) for p in parts], item, least)
                out.append((len(tiles), max([t[2] for t in tiles], default=0), sum(t[2] for t in tiles), len(item)))
            numbers = [pa.array([o[i] for o in out], pa.int32()) for i in range(4)]
            return pa.record_batch([batch.column("_key"), batch.column("item_id"), *numbers], names=["_key", "item_id", "n_tiles", "longest", "matched", "item_words"])

        return handle

    schema = "_key string, item_id long, n_tiles int, longest int, matched int, item_words int"
    tiled = map_rows(both.select("_key", "item_id", "stretches", "words"), start, schema)
    return tiled.withColumn("coverage", F.col("matched") / F.col("item_words"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` and leaked item: ``doc_id, item_id, n_tiles, longest, matched, item_words, coverage``."""
    found = overlaps(docs, items).filter(F.col("coverage") >= threshold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key().alias("_key"))
    return rows.join(found, "_key").drop("_key")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no leaked item, with its columns."""
    found = overlaps(docs, items).filter(F.col("coverage") >= threshold).select("_key").distinct()
    free = "_key" + "_" * max(map(len, docs.columns))
    keyed = docs.withColumn(free, key())
    return keyed.join(found.withColumnRenamed("_key", free), free, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
