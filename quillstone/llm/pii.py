"""Personal data: base patterns, and contexts that are bootstrapped from what these find.

Base.  Four regular expressions give the leftmost non-overlapping matches of each kind; matches
that fail a kind's test (digits, Luhn sum, range of an address part) are dropped.  The
expressions are written with possessive repeats, so that long runs are read once.

Contexts.  A *mention* is a run of words that hold a digit or an ``@``.  Mentions with a base
match are seeds of its kind, and every other one, however few its digits, is open: it may be
found, and until then it counts against the contexts it stands in.  The words around a mention, at three widths, are its lexical
patterns; the mention's own form is no part of them, so that a context learned from seeds finds
identifiers written in any other way.  Patterns and
instances (the mention's text) form a graph with counted edges.  Round by round a pattern's
confidence is the share of its edges that lead to trusted instances, damped for rare patterns,
and an instance's is one minus the product of its patterns' doubts; seeds stay at one for their
kind and zero for the others, and any other instance counts for a pattern once it is held with
``CONFIDENT`` trust, so that a few seeds among many plain numbers carry nothing.  Patterns in high confidence with several seeds then mark the
other mentions they surround: identifiers no expression knows.  An identifier without any digit or
``@`` is no mention and is not found.

Everything is DataFrame functions.  Texts stay in their rows; the graph has only mentions, is
summed by (pattern, instance) before any shuffle to a pattern, and its joins are plain ones on
narrow rows, which adaptive execution splits.  Each round is written to the shared folder.

Cases: null and empty texts have no spans; texts are read whole; equal texts share their
mentions, and repeated rows give a row each; a found span never touches a base span; null ids
pass through; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import whole_text

LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A mention from its first digit or ``@`` on; what its first word holds before that is the end of the gap.
MENTION = r"[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
SPAN = "array<struct<start:bigint,end:bigint,of:string>>"
ROUNDS = 3
DAMPING = 2.0  # edges without trust that every pattern is given
CONFIDENT = 0.7
SEEDS = 3  # different seeds that a pattern needs
CONTEXT_CHARS = 80
BLOCK = 512


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")
    ))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def tester(kind: str):
    return lambda found: valid(kind, found)


def tester_of_span(kind: str):
    return lambda span: valid(kind, span["of"])


def matched(text: Column, pattern: str, name: str, when: Column) -> list[Column]:
    """Two columns: the matches in a text, and what lies between them; both empty unless ``when``.

    They are columns of their own projection, since what follows uses them several times and
    an expression inside it would be searched for as often.
    """
    none = F.array().cast("array<string>")
    return [
        F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{name}_hits"),
        F.when(when, F.split(text, pattern, -1)).otherwise(none).alias(f"{name}_gaps"),
    ]


def located(name: str) -> Column:
    """The matches of ``matched`` with their places: array of (start, end, of).

    Places are running sums of the lengths of gaps and matches, taken in blocks so that the
    cost of appending stays low in texts with very many matches.
    """
    gaps = F.transform(f"{name}_gaps", lambda g: F.length(g).cast("long"))
    hits = F.col(f"{name}_hits")
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("of")))
    size = lambda p: p["gap"] + F.length(p["of"])
    none = F.array().cast("array<bigint>")

    def ends(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("ends"))
        step = lambda a, p: F.struct((a["at"] + size(p)).alias("at"), F.array_append(a["ends"], a["at"] + size(p)).alias("ends"))
        return F.aggregate(block, start, step)["ends"]

    many = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    cut = F.transform(many, lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    local = F.transform(cut, ends)
    totals = F.transform(local, lambda e: F.element_at(e, -1))
    before = F.aggregate(
        totals,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("all")),
        lambda a, t: F.struct((a["at"] + t).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
    )["all"]
    placed = F.flatten(F.zip_with(local, before, lambda e, b: F.transform(e, lambda x: x + b)))
    spans = F.zip_with(placed, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("of")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, text: Column, keep: Column) -> DataFrame:
    """``keep`` with ``text_key`` and one column of spans per kind."""

    def needed(kind: str) -> Column:
        held = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        return held if kind == "email" else held & text.rlike("[0-9]")

    raw = [c for k in KINDS for c in matched(text, BASE[k], k, needed(k))]
    found = docs.select(keep.alias("kept"), F.sha2(text.cast("binary"), 256).alias("text_key"), *raw)
    return found.select("kept", "text_key", *[F.filter(located(k), tester_of_span(k)).alias(k) for k in KINDS])


def mentions(docs: DataFrame, text: Column) -> DataFrame:
    """Every mention of every different text: ``text_key, start, end, core, kind`` (null if no seed) and ``patterns``."""
    rows = docs.select(text.alias("text")).filter(F.col("text").rlike("[0-9@]"))
    parts = rows.select(
        F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), *matched(F.col("text"), MENTION, "mention", F.lit(True))
    ).select("text_key", located("mention").alias("spans"), F.col("mention_gaps").alias("gaps"))
    # read backwards, the start of a mention's first word is a match at the front
    heads = F.transform(F.slice("gaps", F.lit(1), F.size("spans")), lambda g: F.reverse(F.regexp_extract(F.reverse(g), r"^\S*+", 0)))
    parts = parts.select("text_key", "spans", "gaps", heads.alias("heads"))
    head = lambda i: F.coalesce(F.get("heads", i), F.lit(""))
    gap = lambda i: F.left(F.get("gaps", i), F.length(F.get("gaps", i)) - F.length(head(i)))
    # a mention takes its context along, not all gaps of its text
    around = F.transform("spans", lambda s, i: F.struct(
        F.struct((s["start"] - F.length(head(i))).alias("start"), F.concat(head(i), s["of"]).alias("of")).alias("span"),
        F.lower(F.right(gap(i), F.lit(CONTEXT_CHARS))).alias("left"), F.lower(F.left(gap(i + 1), F.lit(CONTEXT_CHARS))).alias("right"),
    ))
    one = parts.select("text_key", F.explode(around).alias("m")).select("text_key", "m.*")
    left, right = F.col("left"), F.col("right")
    lead = F.length(F.regexp_extract("span.of", r"^[^0-9\p{L}@+]*", 0))
    core = F.regexp_replace("span.of", r"^[^0-9\p{L}@+]+|[^0-9\p{L}]+$", "")
    words = one.select(
        "text_key", (F.col("span.start") + lead).alias("start"), core.alias("core"),
        F.regexp_extract(left, r"(\S+)\s*$", 1).alias("l1"), F.regexp_extract(left, r"(\S+)\s+\S+\s*$", 1).alias("l2"),
        F.regexp_extract(right, r"^\s*(\S+)", 1).alias("r1"),
    )
    holds = {k: F.filter(F.regexp_extract_all("core", F.lit(BASE[k]), F.lit(0)), tester(k)) for k in KINDS}
    seed = F.coalesce(*[F.when(F.size(found) > 0, F.lit(k)) for k, found in holds.items()])
    patterns = F.array(
        F.concat_ws(" ", F.lit("L"), "l1"), F.concat_ws(" ", F.lit("LL"), "l2", "l1"), F.concat_ws(" ", F.lit("LR"), "l1", F.lit("_"), "r1")
    )
    return (
        words.filter("core != ''")
        .select("text_key", "start", (F.col("start") + F.length("core")).alias("end"), "core", seed.alias("kind"), patterns.alias("patterns"))
        .dropDuplicates(["text_key", "start"])
    )


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns: ``pattern, kind, trust, seeds``; instances: ``core, kind, trust``) after the rounds."""
    edges = materialise(
        found.select("core", F.col("kind").alias("seed"), F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "core", "seed")
        .agg(F.count("*").cast("double").alias("weight")),
        "pii-edges",
    )
    induced = (
        edges.filter("seed is not null")
        .groupBy("pattern", F.col("seed").alias("kind"))
        .agg(F.approx_count_distinct("core", 0.02).alias("seeds"))
        .filter(F.col("seeds") >= SEEDS)
    )
    graph = materialise(edges.join(induced, "pattern"), "pii-graph")
    own = F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed").isNotNull(), 0.0)
    nobody = graph.select("core", "kind").limit(0).withColumn("trust", F.lit(0.0))
    instances, patterns = nobody, None
    for _ in range(rounds):
        held = F.when(F.col("trust") >= CONFIDENT, F.col("trust"))
        told = graph.join(instances, ["core", "kind"], "left").withColumn("trust", F.coalesce(own, held, F.lit(0.0)))
        patterns = told.groupBy("pattern", "kind").agg(
            (F.sum(F.col("weight") * F.col("trust")) / (F.sum("weight") + DAMPING)).alias("trust"), F.max("seeds").alias("seeds")
        )
        patterns = materialise(patterns, "pii-patterns")
        doubt = F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))
        instances = (
            graph.filter("seed is null").join(patterns.drop("seeds"), ["pattern", "kind"])
            .groupBy("core", "kind").agg((1 - F.exp(F.sum(doubt))).alias("trust"))
        )
        instances = materialise(instances, "pii-instances")
    return patterns, instances


def discovered(docs: DataFrame, text: Column) -> DataFrame:
    """Per different text with finds: ``text_key, found`` (array of kind number, start, end)."""
    seen = materialise(mentions(docs, text), "pii-mentions")
    patterns, instances = bootstrap(seen)
    sure = patterns.filter(F.col("trust") >= CONFIDENT).select("pattern", "kind")
    held = instances.filter(F.col("trust") >= CONFIDENT).select("core", "kind", F.col("trust").alias("_t"))
    open_ = seen.filter("kind is null").drop("kind")
    kinds = F.array(*map(F.lit, KINDS))
    found = (
        open_.select("text_key", "start", "end", "core", F.explode("patterns").alias("pattern"))
        .join(sure, "pattern")
        .join(held, ["core", "kind"])
        .groupBy("text_key", "start", "end")
        .agg(F.max_by("kind", F.struct("_t", "kind")).alias("kind"))
        .groupBy("text_key")
        .agg(F.collect_list(F.struct(F.array_position(kinds, F.col("kind")).alias("k"), "start", "end")).alias("found"))
    )
    return materialise(found, "pii-found")  # a plain table, so that the join with the texts has two plain shuffles


def all_spans() -> Column:
    """Sorted array of (k, start, end): base spans, and the finds that touch none of them."""
    def numbered(i: int):
        return lambda s: F.struct(F.lit(i).cast("long").alias("k"), s["start"].alias("start"), s["end"].alias("end"))

    base = F.concat(*[F.transform(k, numbered(i)) for i, k in enumerate(KINDS, 1)])
    apart = lambda f: ~F.exists(base, lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"]))
    return F.array_sort(F.concat(base, F.coalesce(F.filter("found", apart), F.array().cast("array<struct<k:bigint,start:bigint,end:bigint>>"))))


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"].cast("int")), s["start"], s["end"])), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, base counts per kind, ``base_sha256``, ``spans``."""
    body = whole_text(text)
    based = with_base(docs, body, F.col(doc_id).cast("long")).withColumnRenamed("kept", "doc_id")
    joined = based.join(discovered(docs, body), "text_key", "left")

    def named(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    base_text = F.array_join(F.concat(*[F.transform(k, named(k)) for k in KINDS]), ",")
    return joined.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), listed(all_spans()).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; null texts stay null."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    based = with_base(docs, whole_text(), row).withColumnRenamed("kept", "row")
    spans = F.array_sort(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    joined = based.join(discovered(docs, whole_text()), "text_key", "left").select("row", spans.alias("spans"))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("row.text")
    # spans of two kinds may overlap: the earlier one's tag stands for both
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.array_append(a["out"], F.concat(F.substring(body, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.element_at(tags, s["k"].cast("int")))).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate("spans", first, step)
    tail = F.substring(body, done["at"].cast("int") + 1, F.length(body))
    clean = F.when((F.size("spans") > 0) & body.isNotNull(), F.concat(F.array_join(done["out"], ""), tail)).otherwise(body)
    return joined.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])
