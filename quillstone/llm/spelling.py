"""Groups of spelling variants by finite-state composition.

Words: maximal runs of Latin letters, A-Z lower-cased, counted over all documents.  A keyed
hash of (document, run) takes one code point out of every 31st run, so that the corpus holds
misspellings whose right form is known.

Near words differ by exactly one inserted, deleted or replaced code point.  They are what the
composition of three machines accepts: the minimised acceptor of the vocabulary, a transducer
that makes one edit, and the acceptor again.  Two words at one edit whose shorter one has m
code points share either the first m // 2 or the last m - m // 2 of them.  So the composed
machine falls apart by the state that such a shared part leads to: each (m, side, part) is an
initial-state partition of its own, a key that Spark shuffles on.  A task gets the words of a
partition, builds the minimised acceptor of what they have besides the shared part (from the
other end for a shared ending), and walks the composition: before the edit both copies are in
one state, after it in two, and only strings that both accept are left.  A pair is accepted in
one partition only: that of its own m, and among endings only if the beginnings differ.

A partition holds words of two neighbouring lengths that agree in half their letters; the walk
makes only accepted pairs and dead ends between them, never all pairs of a partition.

A word's form is its near word of the largest count (ties: smallest in code-point order) if
that is ``RATIO`` times its own or more; its root is where following forms ends.  Counts grow
by ``RATIO`` at each step, so pointers double at most five times.

Cases: null and empty texts have no words; runs of any length are read whole; repeated rows
count again; a null id hashes as the empty string; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import map_rows, whole_text

LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
SEEN = 2
RATIO = 10
EVERY = 31
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of ``LEAST`` code points or more that occur ``SEEN`` times or more."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_doc"),
        F.explode(F.regexp_extract_all(whole_text(text), F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("_run"))
    lowered = runs.select("_doc", F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", CAPITALS, SMALL)).otherwise(F.col("_run")).alias("_run"))
    hashed = lowered.select("_run", F.crc32(F.concat_ws(":", "_doc", "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = hashed.select(F.when(F.col("_h") % EVERY == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct strings; state 0 is the initial one."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self.register: dict[tuple, int] = {}
        path, last = [0], ""
        for s in strings:
            shared = len(commonprefix((last, s)))
            self._settle(path, last, shared)
            for c in s[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = s
        self._settle(path, last, 0)

    def _settle(self, path: list[int], last: str, depth: int) -> None:
        """States of ``last`` below ``depth`` get no more arcs: each is replaced by an equal one if there is any."""
        while len(path) > depth + 1:
            state = path.pop()
            same = self.register.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
            self.arcs[path[-1]][last[len(path) - 1]] = same

    def common(self, a: int, b: int, barred: str = "") -> list[str]:
        """Strings accepted from both states that do not begin with ``barred``."""
        out, todo = [], [(a, b, "")]
        while todo:
            p, q, s = todo.pop()
            if self.final[p] and self.final[q]:
                out.append(s)
            onward = self.arcs[q]
            todo += [(r, onward[c], s + c) for c, r in self.arcs[p].items() if c in onward and (s or c != barred)]
        return out

    def one_edit(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted strings at one edit, each once: the composition with the one-edit transducer.

        Of two strings of one length the one with the smaller code point comes first, of others
        the longer one.  In a run of equal code points the last one counts as deleted.
        """
        known: dict[tuple[int, int, str], list[str]] = {}

        def rest(a: int, b: int, barred: str) -> list[str]:
            if (a, b, barred) not in known:
                known[a, b, barred] = self.common(a, b, barred)
            return known[a, b, barred]

        todo = [(0, "")]
        while todo:
            q, done = todo.pop()
            arcs = self.arcs[q]
            for c, a in arcs.items():
                todo.append((a, done + c))
                yield from ((done + c + s, done + s) for s in rest(a, q, c))
                for d, b in arcs.items():
                    if c < d:
                        yield from ((done + c + s, done + d + s) for s in rest(a, b, ""))


def partition_pairs(m: int, ending: bool, part: str, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of ``words`` at one edit whose shorter word has ``m`` code points; ``part`` is what all share."""
    size = len(part)
    if ending:
        machine = Acceptor(sorted(w[: len(w) - size][::-1] for w in words))
        pairs = ((u[::-1] + part, v[::-1] + part) for u, v in machine.one_edit())
        return ((u, v) for u, v in pairs if len(v) == m and u[: m // 2] != v[: m // 2])
    machine = Acceptor(sorted(w[size:] for w in words))
    return ((part + u, part + v) for u, v in machine.one_edit() if len(v) == m - size)


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of near words of ``vocab`` (``word, n``)."""

    def keys(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [
            F.struct(m.alias("m"), F.lit(False).alias("ending"), F.left("word", half).alias("part")),
            F.struct(m.alias("m"), F.lit(True).alias("ending"), F.right("word", m - half).alias("part")),
        ]

    size = F.length("word")
    entered = vocab.select("word", "n", F.explode(F.array(*keys(size), *keys(size - 1))).alias("k")).filter(F.col("k.m") >= LEAST)
    dealt = entered.select("k.m", "k.ending", "k.part", "word", "n").repartition("m", "ending", "part").sortWithinPartitions("m", "ending", "part")
    columns = ("m", "ending", "part", "word", "n")

    def pairs(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        found: list[tuple[str, str, int]] = []
        for (m, ending, part), members in groupby(rows, key=lambda row: row[:3]):
            counts = {row[3]: row[4] for row in members}
            if len(counts) > 1:
                for u, v in partition_pairs(m, ending, part, list(counts)):
                    found += [(u, v, counts[v]), (v, u, counts[u])]
                    if len(found) >= 20_000:
                        yield out(found)
                        found = []
        yield out(found)

    def out(found):
        word, near, n = zip(*found) if found else ((), (), ())
        return pa.record_batch([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    return dealt.mapInArrow(pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms`` (``word, form``): pointers double until none moves."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        at = materialise(at.join(onward, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word of the vocabulary: ``word, form, root, n, n_near, form_n``."""
    vocab = materialise(vocabulary(docs, doc_id, text), "vocabulary")
    best = near_words(vocab).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    holds = -F.col("best.less") >= F.col("n") * RATIO
    joined = materialise(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(joined.filter("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# crc32 byte by byte: the table comes from the polynomial; the rest is the definition in words.
SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST},}}')), '{CAPITALS}', '{SMALL}') AS w FROM documents) GROUP BY 1, 2),
hexed AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
bytes AS (SELECT w, n, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST(instr('0123456789ABCDEF', x[2 * i - 1]) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 17 AS BIGINT)) AS b FROM hexed),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, t),
cut AS (SELECT CASE WHEN h % {EVERY} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(n) >= {SEEN}),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT s.word, f.form FROM steps s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
"""
