"""Averaged subword embeddings under a linear softmax, trained together in numpy.

A word is the bag of itself and its character n-grams (with edge marks), all hashed into one
table of vectors; its vector is their mean, a document's vector the mean over its words, and a
two-class softmax stands on top.  Vectors and softmax are learned together, one document at a
time, by Adagrad steps.  Unseen spellings share n-grams with seen ones.

``shapes`` adds word n-grams to the bag by their form: each window of three words is named by
where its words first occur in it ("012" for three different ones, "000" for one repeated).

Fitting is one task on a bounded sample.  A fitted two-class model is linear in the
bag, so executors get one number per table slot (``margins``) and keep a memo of word values.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MEMO_CHARS, MEMO_ROWS, learned_from, whole_text

SHAPES = ("000", "001", "010", "011", "012")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dims: int = 8
    shortest: int = 3
    longest: int = 5
    lower: bool = True
    shapes: bool = False
    epochs: int = 12
    rate: float = 0.5
    scale: float = 16.0  # the average is multiplied by it before the softmax
    damping: float = 1e-6  # squared gradients that every slot starts with; higher values hold rare slots back
    seed: int = 42


@dataclass(frozen=True)
class Margins:
    """What scoring needs: ``sigmoid(scale * mean(slots of the words) + bias)``."""

    settings: Settings
    slots: np.ndarray
    bias: float


def words_of(text: str, s: Settings) -> list[str]:
    return (text.lower() if s.lower else text).split()


def subwords(word: str, s: Settings) -> list[int]:
    """Table slots of a word: its own and those of its character n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(marked) - n + 1)]
    return [crc32(g.encode("utf-8", "surrogatepass")) % s.buckets for g in (f"={word}", *grams)]


def shape_shares(ids: np.ndarray) -> np.ndarray:
    """Share of each form among the windows of three words; no windows, no shares."""
    if len(ids) < 3:
        return np.zeros(len(SHAPES))
    ab, bc, ac = ids[:-2] == ids[1:-1], ids[1:-1] == ids[2:], ids[:-2] == ids[2:]
    form = np.where(ab & bc, 0, np.where(ab, 1, np.where(ac, 2, np.where(bc, 3, 4))))
    return np.bincount(form, minlength=len(SHAPES)) / len(form)


def bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its table slots, each once, and their weights in the average."""
    known: dict[str, array] = {}
    out = []
    for text in texts:
        words = words_of(text, s)
        index: dict[str, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        for w in index:
            if w not in known:
                known[w] = array("i", subwords(w, s))
        sizes = np.fromiter((len(known[w]) for w in index), np.int64, len(index))
        slots = np.fromiter(chain.from_iterable(map(known.__getitem__, index)), np.int32, int(sizes.sum()))
        weights = np.repeat(np.bincount(ids, minlength=len(index)) / max(len(words), 1) / np.maximum(sizes, 1), sizes)
        if s.shapes:
            slots = np.concatenate([slots, s.buckets + np.arange(len(SHAPES), dtype=np.int32)])
            weights = np.concatenate([weights, shape_shares(ids)])
        unique, where = np.unique(slots, return_inverse=True)
        out.append((unique.astype(np.int32), np.bincount(where, weights, len(unique)).astype(np.float32)))
        if len(known) > MEMO_ROWS:
            known.clear()
    return out


def fit(texts: list[str], labels: list[int], s: Settings) -> Margins:
    """Train vectors and softmax together; without both labels the score is their (smoothed) share everywhere."""
    rng = np.random.default_rng(s.seed)
    size = s.buckets + len(SHAPES)
    vectors = rng.uniform(-1 / s.dims, 1 / s.dims, (size, s.dims)).astype(np.float32)
    seen = np.full(size, s.damping, np.float32)
    top = rng.uniform(-0.5, 0.5, (s.dims, 2)).astype(np.float32)
    seen_top = np.full((s.dims, 2), 1e-2, np.float32)
    share = (sum(labels) + 0.5) / (len(labels) + 2)
    bias = np.log(np.array([1 - share, share], np.float32))
    seen_bias = np.full(2, 1e-2, np.float32)
    if len(set(labels)) < 2:
        return Margins(s, np.zeros(size, np.float32), float(bias[1] - bias[0]))
    rows = bags(texts, s)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for i in rng.permutation(len(rows)):
            slots, weights = rows[i]
            part = vectors[slots]
            hidden = s.scale * (weights @ part)
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            down = s.scale * (top @ p)
            step = np.outer(hidden, p)
            seen_top += step * step
            top -= rate * 0.2 * step / np.sqrt(seen_top)
            seen_bias += p * p
            bias -= rate * 0.2 * p / np.sqrt(seen_bias)
            seen[slots] += weights * weights * float(down @ down) / s.dims
            vectors[slots] = part - (rate * weights / np.sqrt(seen[slots]))[:, None] * down
    return Margins(s, (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; keeps the values of frequent words."""

    def __init__(self, margins: Margins):
        self.s, self.bias = margins.settings, margins.bias
        self.value = margins.slots.astype(float).tolist()
        self.memo: dict[str, float] = {}

    def _word(self, word: str) -> float:
        slots = subwords(word, self.s)
        return sum(map(self.value.__getitem__, slots)) / len(slots)

    def score(self, text: str) -> float:
        words = words_of(text, self.s)
        memo = self.memo
        new = set(words).difference(memo)
        for w in new:
            memo[w] = self._word(w)
        z = math.fsum(map(memo.__getitem__, words)) / len(words) if words else 0.0
        if self.s.shapes and len(words) > 2:
            index = {w: i for i, w in enumerate(set(words))}
            ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            z += float(shape_shares(ids) @ self.value[self.s.buckets :])
        if len(memo) > MEMO_ROWS:
            memo.clear()
        else:
            for w in new:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        z = self.s.scale * z + self.bias
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``_text, _label`` of at most ``rows`` labelled documents that may be learned from.

    The choice is by a hash of the id and so the same on every run; null labels and ids take
    no part, a doubly labelled document counts by its highest label.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learned_from())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most ``rows`` ids are broadcast, and as many texts are kept (an id may repeat)
    found = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(rows).select("_text", "_label")


def learn(docs: DataFrame, labels: DataFrame, label: str, rows: int, s: Settings) -> Margins:
    """Fit on the bounded sample, in one task; the driver gets one number per slot."""

    def run(batches):
        parts = [(b.column("_text").to_pylist(), b.column("_label").to_pylist()) for b in batches]
        m = fit(list(chain.from_iterable(p[0] for p in parts)), list(chain.from_iterable(p[1] for p in parts)), s)
        yield pa.record_batch([pa.array([m.slots.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], names=["slots", "bias"])

    row = sample(docs, labels, label, rows).coalesce(1).mapInArrow(run, "slots binary, bias double").first()
    if row is None:  # nothing was labelled
        return fit([], [], s)
    return Margins(s, np.frombuffer(row.slots, np.float32), row.bias)


_SCORERS: dict[int, Scorer] = {}


def scorer(shipped) -> Scorer:
    """The worker's scorer for a broadcast model; one at a time is kept from task to task."""
    key = id(shipped.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shipped.value)
    return _SCORERS[key]
