"""Byte-level BPE over a sentencepiece model that is written from a rank file.

The rank file (token bytes, rank) is the whole vocabulary.  Every byte gets a printable
stand-in character, so a token is a string of stand-ins, and a sentencepiece BPE model is
serialised from those pieces with score ``-rank`` and a normaliser that changes nothing.
The best-scored merge is then the lowest rank, leftmost first.  A pre-token that is in the
vocabulary as a whole is that token; any other one goes through the model.

Decoding looks up each id's stand-ins and maps them back to bytes.

Cases: a null text is the empty text, which has no ids and decodes to no bytes; a text is
never cut; repeated rows give repeated results; ids of other vocabularies raise IndexError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK, MEMO_CHARS, MEMO_ROWS, groups, map_rows, whole_text


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is ``tokens[i]``, the unknown piece comes last."""
    letters = byte_letters()
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    unknown = "⁇unknown"
    pieces.append(_field(1, _field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)))
    trainer = (
        _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1)
        + _field(43, -1) + _field(45, unknown.encode())
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks are not 0 to n-1")
        tokens = sorted(ranks, key=ranks.get)
        letters = byte_letters()
        self.ranks = ranks
        self.numbers = [str(i) for i in range(len(tokens))]
        self.to_letters = {i: c for i, c in enumerate(letters)}
        back = {c: i for i, c in enumerate(letters)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.pretokens = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks that the memo lacks into it."""
        find, ranks = self.pretokens.findall, self.ranks
        parts = [tuple(map(str.encode, find(c))) for c in chunks]
        odd = [p for p in set(chain.from_iterable(parts)) if p not in ranks]
        lettered = [p.decode("latin-1").translate(self.to_letters) for p in odd]
        made = dict(zip(odd, self.model.encode(lettered, out_type=int, num_threads=1)))
        for c, ps in zip(chunks, parts):
            self.memo[c] = tuple(i for p in ps for i in (made[p] if p in made else (ranks[p],)))

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of whole texts.

        A match of the pattern never reaches over the edge between a word and the white
        space after it, so a text may be cut there and equal chunks encoded once.
        """
        for start, stop in groups(texts):
            cut = [CHUNK.findall(t) for t in texts[start:stop]]
            new = set().union(*cut).difference(self.memo)
            self._learn(list(new))
            for chunks in cut:
                yield list(chain.from_iterable(map(self.memo.__getitem__, chunks)))
            if len(self.memo) > MEMO_ROWS:
                self.memo.clear()
            else:
                for c in new:
                    if len(c) > MEMO_CHARS:
                        del self.memo[c]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int), the tokens of each whole text."""

    def start():
        bpe = codec(rank_file, pattern)

        def handle(batch):
            ids = pa.array(list(bpe.encode_many(batch.column("_text").to_pylist())), pa.list_(pa.int32()))
            return pa.record_batch([*[batch.column(k) for k in keep], ids], names=[*keep, "ids"])

        return handle

    rows = docs.select(*keep, whole_text(text).alias("_text"))
    return map_rows(rows, start, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep) + ", ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded`` (binary), the bytes that ``ids`` stand for; null ids are no ids."""

    def start():
        bpe = codec(rank_file, pattern)

        def handle(batch):
            made = pa.array([bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.binary())
            return pa.record_batch([*[batch.column(k) for k in keep], made], names=[*keep, "decoded"])

        return handle

    rows = tokens.select(*keep, "ids")
    return map_rows(rows, start, ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep) + ", decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; encodes, then decodes the ids, in one pass."""

    def start():
        bpe = codec(rank_file, pattern)

        def handle(batch):
            counts, of_ids, of_bytes = [], [], []
            for ids in bpe.encode_many(batch.column("_text").to_pylist()):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return handle

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    return map_rows(rows, start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
