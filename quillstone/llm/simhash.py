"""SimHash near-duplicates by a self-join of binary tries.

Fingerprint: words are runs of anything but ASCII white space, A-Z lower-cased; each window of
four words (a shorter text as a whole) is hashed with XXH64, seed 42, and a bit of the
fingerprint is set if more than half the hashes have it set.

Join: two fingerprints link at ``BUDGET`` or fewer differing bits.  The 64 bits are cut into
``BUDGET + 2`` blocks; ``BUDGET`` errors leave two blocks clean, so for each choice of two the
bits are ordered with these first, and in that order's trie the top levels admit no error.
Pairs of nodes at that depth are equal prefixes, an equi-join that Spark shuffles; below it a
task walks pairs of nodes of the two subtrees together, adds up differing bits, and drops a
pair of nodes when the sum passes the budget.  A pair of nodes whose leaves are already linked
in one run has nothing to add and is dropped too, so a large group of near copies costs its
spanning links and not all its pairs.

A prefix with more than ``CELL`` fingerprints is cut into blocks by a hash, and each pair of
blocks is a cell of its own, so no group is unbounded in a task.  Copies share a fingerprint
and are one leaf.

Cases: null and empty texts have no words and fingerprint zero, and link like any other;
very long texts are read whole; repeated rows are copies; null ids count as the largest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import materialise
from .common import map_rows, whole_text
from .components import components

SHINGLE = 4
SEED = 42
BUDGET = 4
CELL = 512


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, text_key`` (a hash of the text) and ``fp`` (the fingerprint's bits as a long)."""

    def start():
        def handle(batch):
            made = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            return pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(made)], names=["doc_id", "text_key", "fp"])

        return handle

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole_text(text)).alias("text_key"), whole_text(text).alias("_text"))
    return map_rows(rows, start, "doc_id long, text_key long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def join_tries(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups: index pairs whose union connects all that differ in ``budget`` bits or fewer.

    ``group`` is sorted, ``fp`` (unsigned) sorted and distinct inside each group.  Every pair of
    neighbours in budget is linked; what these runs leave open is found by walking node pairs.
    """
    near = (group[1:] == group[:-1]) & (popcount(fp[1:] ^ fp[:-1]) <= budget)
    run = np.concatenate([[0], np.cumsum(~near)])
    left, right = [np.flatnonzero(near)], [np.flatnonzero(near) + 1]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], len(group))
    a, ae, b, be, err = first, last, first, last, np.zeros(len(first), np.int64)
    for level in range(63, -1, -1):
        # a run of linked neighbours has no open pair inside; a lone leaf has none with itself
        keep = run[np.minimum(a, b)] != run[np.maximum(ae, be) - 1]
        a, ae, b, be, err = a[keep], ae[keep], b[keep], be[keep], err[keep]
        leaf = (ae - a == 1) & (be - b == 1)
        left.append(a[leaf])
        right.append(b[leaf])
        a, ae, b, be, err = a[~leaf], ae[~leaf], b[~leaf], be[~leaf], err[~leaf]
        if not len(a):
            break
        ones = np.concatenate([[0], np.cumsum(fp >> np.uint64(level) & np.uint64(1)).astype(np.int64)])
        am, bm = ae - (ones[ae] - ones[a]), be - (ones[be] - ones[b])
        other = a != b  # a node with itself: its two mixed pairs are one
        a, ae, b, be, err = (
            np.concatenate(x)
            for x in (
                (a, am, a, am[other]), (am, ae, am, ae[other]), (b, bm, bm, b[other]), (bm, be, be, bm[other]),
                (err, err, err + 1, err[other] + 1),
            )
        )
        keep = (a < ae) & (b < be) & (err <= budget)
        a, ae, b, be, err = a[keep], ae[keep], b[keep], be[keep], err[keep]
    else:
        left.append(a)
        right.append(b)
    x, y = np.concatenate(left), np.concatenate(right)
    ok = popcount(fp[x] ^ fp[y]) <= budget
    x, y = x[ok], y[ok]
    # one link for each pair of runs is enough
    inside = run[x] == run[y]
    low, high = np.minimum(run[x], run[y])[~inside], np.maximum(run[x], run[y])[~inside]
    _, once = np.unique(np.stack([low, high]), axis=1, return_index=True) if len(low) else (None, np.zeros(0, np.int64))
    return np.concatenate([x[inside], x[~inside][once]]), np.concatenate([y[inside], y[~inside][once]])


def block_keys(fp: Column, budget: int) -> Column:
    """Array of one key per order: the order's number and its two clean blocks."""
    n = budget + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    widths = [edges[i + 1] - edges[i] for i in range(n)]
    keys = [
        F.lit(k << 48).cast("long") + F.shiftleft(blocks[i], widths[j]) + blocks[j]
        for k, (i, j) in enumerate(combinations(range(n), 2))
    ]
    return F.array(*keys)


def links(distinct: DataFrame, budget: int = BUDGET, cell: int = CELL) -> DataFrame:
    """Columns ``a, b``: links between different fingerprints (column ``fp``, distinct) that connect each class."""
    if not 0 <= budget <= 20:
        raise ValueError("budget must be 0 to 20")
    keyed = distinct.select(F.explode(block_keys(F.col("fp"), budget)).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / cell)
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    cells = (
        keyed.join(sizes, "key")
        .select("key", "fp", blocks.alias("blocks"))
        .select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
            "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp",
        )
    )
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "key", "i", "j", "fp").select("cell", "key", "i", "j", "fp")

    def run(batches):
        held = None
        for batch in _with_end(batches):
            rows = held
            if batch is not None:
                new = np.stack([batch.column(c).to_numpy() for c in ("cell", "key", "i", "j", "fp")], axis=1)
                rows = new if held is None else np.concatenate([held, new])
            if rows is None or not len(rows):
                continue
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            cut = len(rows) if batch is None else (change[-1] if len(change) else 0)  # the last group may go on
            held, rows = rows[cut:], rows[:cut]
            if not len(rows):
                continue
            group = np.concatenate([[0], np.cumsum((rows[1:, :4] != rows[:-1, :4]).any(axis=1))])
            fp = rows[:, 4].astype(np.int64).view(np.uint64)
            order = np.lexsort((fp, group))  # signed order becomes unsigned
            group, fp = group[order], fp[order]
            x, y = join_tries(group, fp, budget)
            yield pa.record_batch([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def classes(docs: DataFrame, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, text_key, fp, root`` (a fingerprint that names the class) and ``component_id`` (its smallest id)."""
    prints = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(distinct.select("fp"), budget))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of each class, all columns of ``docs``: the smallest id (null ids last), then the smallest text key."""
    made = classes(docs, budget)
    alike = made.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = (
        alike.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("best"))
        .select("root", F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key"), F.col("best.n").alias("n"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole_text()).alias("text_key"))
    kept = rows.join(best, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    # rows that agree in id and text are told apart by their other columns
    alone = kept.filter("n = 1").select("row")
    one = kept.filter("n > 1").groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return alone.unionByName(one).select("row.*")
