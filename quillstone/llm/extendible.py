"""Exact duplicates by an extendible-hash index on shared files.

Pages: each task reads its splits, hashes every whole text (XXH64, 64 bits) and keeps the texts
it has seen in a page of bounded bytes.  A row whose text is in the page points to that entry;
any other row becomes an entry and carries its text.  So a task writes a text once per page,
however many copies it holds.  Pages are Parquet files in the shared folder; all further steps
read them, so a lost executor repeats its own task and nothing else.

Directory: slots are the leading bits of the hash, buckets are what slots point to.  Every
bucket starts at the depth at which a mean one is about full; while any is overfull the
directory doubles, and each overfull bucket is split by one more bit.  A bucket of one hash
cannot be split.  Depth ends at ``MOST_DEPTH``, which bounds the directory to 2^18 rows; a
bucket that is still overfull there keeps a longer chain of pages, which costs time, not
results, since owners stream.

Owners: neighbouring buckets, that is key ranges, are packed into owner tasks of about equal
bytes.  An owner reads its entries sorted by hash and chains the texts of one hash: an entry
is compared with each text of the chain, byte for byte, and joins the one it equals or
lengthens the chain.  An owner holds one chain at a time.  Texts are equal only if their bytes
are; the hash decides nothing but the place.

Result: the group's largest (doc_id, row) stays.  Only entries move with their text, once;
all else that moves are numbers, combined before each shuffle.

Cases: a null text is the empty text; texts are read whole; of repeated rows with one doc_id
one row is kept and the others are not; null ids count as the smallest; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise
from .common import map_rows, whole_text

PAGE_BYTES = 32 << 20  # texts a task holds while it fills a page
BUCKET_BYTES = 4 << 20  # load at which a bucket is overfull
OWNER_BYTES = 16 << 20  # texts of one owner task, more once there would be MOST_OWNERS
MOST_OWNERS = 1 << 14
MOST_DEPTH = 18
ROW_BITS = 36  # rows of one task; the task's number is above them


class Pages:
    """Entries of one task: hash -> [(text, entry)], emptied when it holds ``limit`` bytes."""

    def __init__(self, limit: int):
        self.limit, self.held, self.seen = limit, 0, {}

    def entry(self, h: int, text: str, row: int) -> int:
        """The entry of an equal text in the page, else ``row`` itself."""
        chain = self.seen.setdefault(h, [])
        for known, entry in chain:
            if known == text:
                return entry
        chain.append((text, row))
        self.held += len(text)
        if self.held > self.limit:
            self.held, self.seen = 0, {}
        return row


def write_pages(docs: DataFrame, doc_id: str, text: str, hashed: Column) -> DataFrame:
    """``row, doc_id, h, entry, n_bytes, digest, text``: the last two only where ``entry = row``."""
    limit = PAGE_BYTES

    def start():
        pages, base, at = Pages(limit), TaskContext.get().partitionId() << ROW_BITS, 0

        def handle(batch):
            nonlocal at
            texts, hashes = batch.column("_text").to_pylist(), batch.column("_h").to_pylist()
            rows = range(base + at, base + at + len(texts))
            at += len(texts)
            entries = [pages.entry(h, t, r) for h, t, r in zip(hashes, texts, rows)]
            new = [t if e == r else None for t, e, r in zip(texts, entries, rows)]
            digests = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in new]
            made = [pa.array(rows, pa.int64()), pa.array(entries, pa.int64()), pa.array(digests, pa.string()), pa.array(new, pa.string())]
            return pa.record_batch(
                [made[0], batch.column("_doc"), batch.column("_h"), made[1], batch.column("_bytes"), made[2], made[3]],
                names=["row", "doc_id", "h", "entry", "n_bytes", "digest", "text"])

        return handle

    rows = docs.select(F.col(doc_id).cast("long").alias("_doc"), whole_text(text).alias("_text")).select(
        "_doc", "_text", hashed.alias("_h"), F.octet_length("_text").cast("long").alias("_bytes"))
    return materialise(map_rows(rows, start, "row long, doc_id long, h long, entry long, n_bytes long, digest string, text string"), "pages")


def leading(h: Column | str, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash, one at least."""
    return F.shiftrightunsigned(h, 64 - depth)


def directory(keys: DataFrame, load: int) -> tuple[DataFrame, int]:
    """The directory (``slot, prefix, depth, bytes``) over ``keys`` (``h, bytes``), and its depth in bits.

    Splitting works on sums at the deepest level, at most 2^18 rows, whatever the input.
    """
    depth = min(MOST_DEPTH, max(1, math.ceil(math.log2(max(2, load / BUCKET_BYTES)))))
    most = min(MOST_DEPTH, depth + 8)
    open_ = materialise(keys.groupBy(leading("h", most).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys")), "leaves")
    closed = None
    while True:
        prefix = F.shiftright("leaf", most - depth)
        level = materialise(open_.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys")), "level")
        full = (F.col("bytes") > BUCKET_BYTES) & (F.col("keys") > 1) & F.lit(depth < most)
        buckets = level.filter(~full).select("prefix", F.lit(depth).alias("depth"), "bytes")
        closed = buckets if closed is None else closed.unionByName(buckets)
        split = level.filter(full).select("prefix")
        if split.isEmpty():
            break
        open_ = open_.withColumn("prefix", prefix).join(split, "prefix", "left_semi").drop("prefix")
        depth += 1
    below = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), below)
    slots = F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1)
    return closed.select(F.explode(slots).alias("slot"), "prefix", "depth", "bytes"), depth


def chains(entries: DataFrame) -> DataFrame:
    """``entry, head``: the first entry of the same bytes, for rows sorted by ``h`` in each partition."""

    def start():
        current, chain = None, []

        def handle(batch):
            nonlocal current, chain
            heads = []
            for h, entry, text in zip(*(batch.column(c).to_pylist() for c in ("h", "entry", "text"))):
                if h != current:
                    current, chain = h, []
                head = next((e for known, e in chain if known == text), None)
                if head is None:
                    chain.append((text, entry))
                heads.append(entry if head is None else head)
            return pa.record_batch([batch.column("entry"), pa.array(heads, pa.int64())], names=["entry", "head"])

        return handle

    return map_rows(entries, start, "entry long, head long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed: Column | None = None) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``hashed`` places the texts, a long expression of ``_text``; results do not depend on it.
    """
    pages = write_pages(docs, doc_id, text, F.xxhash64("_text") if hashed is None else hashed)
    entries = pages.filter(F.col("entry") == F.col("row"))
    keys = materialise(entries.groupBy("h").agg(F.sum("n_bytes").alias("bytes")), "keys")
    load = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    slots, depth = directory(keys, load)

    size = max(OWNER_BYTES, -(-load // MOST_OWNERS))
    before = F.sum("bytes").over(W.orderBy("prefix_at").rowsBetween(W.unboundedPreceding, W.currentRow))
    # one row per bucket, at most 2^18 of them: the running sum needs no more than one task
    owner = slots.groupBy("prefix", "depth").agg(F.min("slot").alias("prefix_at"), F.first("bytes").alias("bytes")).withColumn(
        "owner", F.floor((before - F.col("bytes")) / size).cast("int")).select("prefix", "depth", "owner")
    owned = materialise(slots.join(owner, ["prefix", "depth"]).select("slot", "owner"), "directory")
    placed = entries.select("h", "entry", "text", leading("h", depth).alias("slot")).join(F.broadcast(owned), "slot")
    dealt = placed.select("h", "entry", "text", "owner").repartitionById(max(1, -(-load // size)), "owner")
    heads = materialise(chains(dealt.sortWithinPartitions("h", "entry").select("h", "entry", "text")), "chains")

    per_entry = pages.groupBy("entry").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n"))
    per_head = per_entry.join(heads, "entry").groupBy("head").agg(F.max("last").alias("last"), F.sum("n").alias("group_size"))
    named = per_head.join(entries.select(F.col("entry").alias("head"), "digest"), "head")
    known = materialise(heads.join(named, "head").select("entry", "last", "group_size", "digest"), "groups")
    return pages.select("row", "doc_id", "entry").join(known, "entry").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of the rows that stay, one per distinct text."""
    return groups(docs, doc_id, text).filter("kept").select("doc_id")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
