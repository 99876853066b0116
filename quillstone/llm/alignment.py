"""Alignment of two tokenizers over the same bytes.

A is a byte-level BPE read by ``tokenizers``, B a sentencepiece model; both encode a text with
a space before it (B puts it there itself).  Where a token of A and a token of B end at the
same byte, the text is cut; the cuts make groups of tokens that stand for the same bytes, and
the two tokens that end there are linked.

Spans: A's library gives character offsets, B's library the byte spans of its proto (the
installed version offers the mutable proto alone, which holds the same spans as the immutable
one).  A token whose span is its own ends where the span says.  Tokens that share a character
(parts of a multibyte one in A, fallback bytes in B) have spans that overlap or are empty;
from the last such end on, their ends follow from the number of bytes each decodes to.

Neither tokenizer joins anything over the edge between a character that is no white space and
a space after it, so texts are cut there and equal chunks are aligned once per task.

Corpus: links are counted per text as (pair of ids, times).  The pairs' counts over all texts
are a Spark aggregate; they go back to the texts in two parts.  The ``FREQUENT`` most counted
pairs, a proven number, are broadcast and cover nearly all links, the hot ones first; what is
left is joined by the pair.  Sums per text combine before the shuffle.

Cases: null and empty texts, and texts whose tokens do not give their bytes back (B writes a
space for U+2581), have no tokens: zeros and no groups; texts are read whole; repeated rows
count again and give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..session import materialise
from .byte_bpe import byte_letters
from .common import MEMO_CHARS, groups, map_rows, whole_text

EDGE = re.compile(r"(?<=\S)(?= )")
SPACE = "▁"
FREQUENT = 1 << 16
B_BITS = 20  # a pair is one number: A's id above B's
MEMO = 100_000
ROW_BITS = 36


class Aligned(NamedTuple):
    """One chunk: token counts, cut positions in bytes, groups as text, linked pairs."""

    n_a: int
    n_b: int
    cuts: tuple[int, ...]
    groups: str
    links: tuple[int, ...]


def ends(starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes: by its span if that is its own, else by what it decodes to.

    A span is a token's own if it is not empty and no neighbour's reaches into it.
    """
    if not len(starts):
        return stops
    own = (stops > starts) & (np.r_[0, stops[:-1]] <= starts) & (np.r_[starts[1:], stops[-1]] >= stops)
    last = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))  # the coarse cut before each token, or its own
    decoded = np.cumsum(sizes)
    return np.where(last < 0, decoded, stops[last] + decoded - decoded[last])


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.a_bytes = np.full(max(vocabulary.values()) + 1, b"", object)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = np.array([self._of_piece(i) for i in range(self.b.vocab_size())], object)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.a_last = (np.array([f"{i}{mark}" for i in range(len(self.a_sizes))], object) for mark in ",|")
        self.b_names, self.b_last = (np.array([f"{i}{mark}" for i in range(len(self.b_sizes))], object) for mark in ",;")
        self.b_space = self.b.piece_to_id(SPACE)
        self.memo: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}  # the memo before it last grew too large
        self.pairs: dict[int, int] = {}  # one object per pair

    def _of_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE, " ").encode()

    def _align(self, chunks: list[str]) -> list[Aligned] | None:
        """Chunks that follow each other as one text, aligned each; None if its tokens are not its bytes."""
        text = "".join(chunks)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        # B's spans follow each other, so their ends tell their starts; a lone space is all prefix to B
        read = np.array([x for p in b for x in (p.id, p.end)] or [self.b_space, 0]).reshape(-1, 2)
        a_ids, b_ids = np.array(a.ids), read[:, 0]
        if b"".join(self.a_bytes[a_ids].tolist()) != raw or b"".join(self.b_bytes[b_ids].tolist()) != raw:
            return None
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at_char = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
        spans = at_char[np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(a_ids))]
        a_ends = ends(spans[::2], spans[1::2], self.a_sizes[a_ids])
        # they are spans of the text without its prefix, whose space is the first byte
        b_stops = read[:, 1] + 1
        b_ends = ends(np.r_[0, b_stops[:-1]], b_stops, self.b_sizes[b_ids])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        i_end, j_end = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        # all tokens in the order in which the groups are written, each with the mark that follows it
        i_sizes, j_sizes = np.diff(i_end, prepend=-1), np.diff(j_end, prepend=-1)
        written = np.empty(len(a_ids) + len(b_ids), object)
        written[np.arange(len(a_ids)) + np.repeat(j_end + 1 - j_sizes, i_sizes)] = self.a_names[a_ids]
        written[np.arange(len(b_ids)) + np.repeat(i_end + 1, j_sizes)] = self.b_names[b_ids]
        written[i_end + j_end + 1 - j_sizes] = self.a_last[a_ids[i_end]]
        written[i_end + j_end + 1] = self.b_last[b_ids[j_end]]
        written = written.tolist()
        links = [self.pairs.setdefault(x, x) for x in (a_ids[i_end] << B_BITS | b_ids[j_end]).tolist()]
        edges = np.cumsum([len(c.encode()) for c in chunks])
        last = np.searchsorted(cuts, edges)  # the group that ends with each chunk
        inner = (cuts - np.repeat(edges - np.diff(edges, prepend=0), np.diff(last, prepend=-1))).tolist()
        out, g, p, q = [], 0, 0, 0
        for end, i, j in zip((last + 1).tolist(), (i_end[last] + 1).tolist(), (j_end[last] + 1).tolist()):
            out.append(Aligned(i - p, j - q, tuple(inner[g:end]), "".join(written[p + q : i + j])[:-1], tuple(links[g:end])))
            g, p, q = end, i, j
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Put new chunks into the memo: those that end in no white space may follow each other as one text."""
        closed = [c for c in chunks if not c[-1].isspace()]
        runs = [closed[i:j] for i, j in groups(closed, 20_000)] + [[c] for c in chunks if c[-1].isspace()]
        while runs:
            run = runs.pop()
            made = self._align(run)
            if made is None and len(run) > 1:  # find the chunks that B writes differently
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]
            else:
                self.memo.update(zip(run, made or [None]))

    def align_many(self, texts: list[str]):
        """Per text its aligned chunks; None for a text without tokens."""
        for start, stop in groups(texts, 1_000_000):
            cut = [EDGE.split(" " + t) if t else [] for t in texts[start:stop]]
            new = set().union(*cut).difference(self.memo)
            known = new & self.older.keys()
            self.memo.update((c, self.older[c]) for c in known)
            self._learn(list(new - known))
            for chunks in cut:
                made = list(map(self.memo.__getitem__, chunks))
                yield None if not made or None in made else made
            if len(self.memo) > MEMO:
                self.memo, self.older, self.pairs = {}, self.memo, {}
            else:
                for c in new:
                    if len(c) > MEMO_CHARS:
                        del self.memo[c]


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def spans(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, groups, cuts``: groups of ids as text, and the byte each group ends at, in space+text."""

    def start():
        both = aligner(a_file, b_file)

        def handle(batch):
            texts, cuts = [], []
            for made in both.align_many(batch.column("_text").to_pylist()):
                texts.append(";".join(m.groups for m in made or []))
                bases = accumulate((m.cuts[-1] for m in made or []), initial=0)
                cuts.append([base + c for base, m in zip(bases, made or []) for c in m.cuts])
            return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "groups", "cuts"])

        return handle

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    return map_rows(rows, start, "doc_id long, groups string, cuts array<long>")


def linked(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs``: pairs with their times in the text."""

    def start():
        both, base, at = aligner(a_file, b_file), TaskContext.get().partitionId() << ROW_BITS, 0

        def handle(batch):
            nonlocal at
            columns: list[list] = [[] for _ in range(5)]
            pairs, times, stops = [], [], [0]
            for made in both.align_many(batch.column("_text").to_pylist()):
                made = made or []
                links = Counter(chain.from_iterable([m.links for m in made]))
                pairs += links.keys()
                times += links.values()
                stops.append(len(pairs))
                digest = hashlib.sha256(";".join([m.groups for m in made]).encode()).hexdigest() if made else ""
                n_groups = sum([len(m.cuts) for m in made])
                for column, x in zip(columns, (sum([m.n_a for m in made]), sum([m.n_b for m in made]), n_groups, sum(links.values()), digest)):
                    column.append(x)
            numbers = pa.array(range(base + at, base + at + len(stops) - 1), pa.int64())
            at += len(stops) - 1
            linked_ = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], ["pair", "times"])
            made_ = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])]
            return pa.record_batch(
                [numbers, batch.column("doc_id"), *made_, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), linked_)],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

        return handle

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, times: long>>"
    return map_rows(rows, start, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair over all texts; best if no pair with its B id has more."""
    counted = materialise(rows.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.times").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b_id).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rows = materialise(linked(docs, a_file, b_file, doc_id, text), "aligned")
    counts = materialise(pair_counts(rows), "pair-counts")
    frequent = materialise(counts.orderBy(F.desc("n"), "pair").limit(FREQUENT), "frequent")
    met = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.times")
    common = met.join(F.broadcast(frequent), "pair")
    rare = met.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(counts, "pair")
    sums = common.unionByName(rare).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
