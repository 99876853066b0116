"""Published documents, listings and label lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .ranking import latest, running_total
from .urls import top_rows


def top_labels(df: DataFrame, group: str, ord_: str, label: str, n: int) -> DataFrame:
    """First ``n`` non-empty labels per group in order, joined with ', '.

    The group limit applies before the shuffle; at most ``n`` labels per group are gathered.
    """
    kept = top_rows(df.filter(F.length(label) > 0), [group], [F.col(ord_)], n, "_r")
    return kept.groupBy(group).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_r", label))), lambda x: x[label]), ", "
        ).alias("labels")
    )


#: Characters of a part: a row starts a new part when this many lie before it.
PART_CHARS = 1 << 20


def build_metadata(atoms: DataFrame, build: str) -> DataFrame:
    """Totals, flagged, included, pillar counts and mean confidence per build."""
    kept = F.coalesce(F.col("status") != "flagged", F.lit(True))
    cat = F.coalesce("category", F.lit("general"))
    per = atoms.groupBy(build, cat.alias("category")).agg(
        F.count("*").alias("n"), F.count(F.when(kept, 1)).alias("kept"),
        F.sum(F.when(kept, F.coalesce("confidence", F.lit(0.5)))).alias("conf"))
    return per.groupBy(build).agg(
        F.sum("n").alias("atoms_total"), F.sum("kept").alias("atoms_included"), (F.sum("n") - F.sum("kept")).alias("atoms_flagged"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kept") > 0, F.struct("category", "kept"))))).alias("pillars"),
        F.bround(F.coalesce(F.sum("conf") / F.sum("kept"), F.lit(0.0)), 3).alias("avg_confidence"))


def package_stats(atoms: DataFrame, by: list[str]) -> DataFrame:
    ok = F.col("status").isin("verified", "updated")

    def n(src: str) -> Column:
        return F.count(F.when(F.col("source") == src, 1))

    a = atoms.groupBy(*by).agg(
        F.count("*").alias("total_atoms"), F.count(F.when(ok, 1)).alias("verified"), n("transcript").alias("from_transcript"),
        n("baseline").alias("from_baseline"), n("codebase").alias("from_codebase"))
    return a.withColumn("verified_pct", F.bround(F.col("verified") / F.col("total_atoms") * 100, 1))


def pattern_type(tags: Column, types: tuple[str, ...]) -> Column:
    """First tag that names a pattern type, else general."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t.isin(*types)), F.lit(0)), F.lit("general"))


def pillar_parts(atoms: DataFrame, category: str, order: str) -> DataFrame:
    """Pillar documents as numbered parts of about ``PART_CHARS`` characters.

    A pillar may hold any share of the atoms: positions are running sums over ranges, a part
    gathers a bounded length, and the parts joined by newlines in order are the document.
    """
    entry = F.concat(
        F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), F.coalesce("content", F.lit("")),
        F.when(F.size("tags") > 0, F.concat(F.lit("\n\n*Tags: "), F.array_join("tags", ", "), F.lit("*"))).otherwise(""), F.lit("\n"))
    slim = atoms.select(category, order, entry.alias("_md"))
    placed = running_total(slim, [F.col(order)], F.length("_md") + 1, "_end", (category,))
    start = F.col("_end") - F.length("_md") - 1
    parts = placed.withColumn("part", F.floor(start / PART_CHARS)).groupBy(category, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_end", "_md"))), lambda x: x["_md"]), "\n").alias("body"),
        F.count("*").alias("atoms"))
    head = F.when(F.col("part") == 0, F.concat(F.lit("# "), F.col(category), F.lit("\n\n"))).otherwise("")
    return parts.select(category, "part", "atoms", F.concat(head, "body").alias("markdown"))


def routing(atoms: DataFrame, category: str, order: str) -> DataFrame:
    """One routing line per pillar with its first three titles."""
    top = top_rows(atoms, [category], [F.col(order)], 3, "_r").groupBy(category).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]), ", ").alias("topics"))
    display = F.initcap(F.replace(F.col(category), F.lit("_"), F.lit(" ")))
    return top.select(category, F.concat(
        F.lit("- If user asks about **"), display, F.lit("** ("), "topics", F.lit(") -> see `knowledge/"), category, F.lit(".md`")).alias("line"))


def confidence_level(note: Column, reference: Column, levels: int = 2, strict_status: Column | None = None) -> Column:
    """VERIFIED / UNVERIFIED, or HIGH / MEDIUM / LOW by score with ``levels=4``."""
    from ..functions.text import noted_score

    score = noted_score(F.coalesce(note, F.lit("")))
    has_ref = F.length(F.coalesce(reference, F.lit(""))) > 0
    if strict_status is not None:
        return F.when(strict_status.isin("verified", "updated"), "VERIFIED").otherwise("UNVERIFIED")
    if levels == 4:
        return (F.when(score >= 0.70, "HIGH").when(score >= 0.50, "MEDIUM").when(score.isNotNull(), "LOW")
                .when(has_ref, "HIGH").otherwise("LOW"))
    return F.when(score.isNotNull() | has_ref, "VERIFIED").otherwise("UNVERIFIED")


def confidence_map(leveled: DataFrame, level: str, order: str, title: str) -> DataFrame:
    """Count, first titles (15 verified, 10 unverified) and remainder per level."""
    counts = leveled.groupBy(level).agg(F.count("*").alias("atoms"))
    shown = F.when(F.col(level) == "UNVERIFIED", 10).otherwise(15)
    top = top_rows(leveled, [level], [F.col(order)], 15, "_r").filter(F.col("_r") <= shown)
    lists = top.groupBy(level).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", title))), lambda x: x[title]).alias("titles"))
    return counts.join(lists, level).withColumn("more", F.greatest(F.col("atoms") - shown, F.lit(0)))


def is_expert_tip(note: Column) -> Column:
    n = F.coalesce(note, F.lit(""))
    return n.contains("Expert insight") | n.contains("not found in official")


def top_strategies(atoms: DataFrame, note: str, order: str, k: int = 10) -> DataFrame:
    sure = atoms.filter(~is_expert_tip(F.col(note)) & (F.col("confidence") >= 0.9))
    return sure.orderBy(order).limit(k)


def diverse_top(atoms: DataFrame, category: str, order: str, k: int = 8) -> DataFrame:
    """By confidence: the first of each category, then the rest, ``k`` rows in all.

    Of the rest only the best ``2 k`` rows can be chosen.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), F.col(order).alias("o"))
    rest = [c for c in atoms.columns]
    heads = atoms.groupBy(category).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select("_row.*")
    heads = heads.orderBy(F.col("confidence").desc(), order).limit(k).withColumn("_tier", F.lit(0))
    fill = atoms.orderBy(F.col("confidence").desc(), order).limit(2 * k).join(heads.select(order), order, "left_anti")
    return heads.unionByName(fill.withColumn("_tier", F.lit(1))).orderBy("_tier", F.col("confidence").desc(), order).limit(k).drop("_tier")


CONTEXT_CHARS, TESTS = 4000, 5


def test_contexts(tests: DataFrame, atoms: DataFrame, order: str) -> DataFrame:
    """(test_id, pos, entry): entries that fit the context budget of each of the five tests.

    An entry has at least six characters (title and content may be empty), so a budget
    holds at most ``CONTEXT_CHARS / 6`` entries; that many candidates per test are enough.
    """
    most = CONTEXT_CHARS // 6 + 1
    few = tests.orderBy("test_id").limit(TESTS)
    entry = F.concat(F.lit("### "), F.coalesce("title", F.lit("N/A")), F.lit("\n"), F.left("content", F.lit(400)), F.lit("\n"))
    a = atoms.select(order, "confidence", F.lower("title").alias("_t"), F.lower("category").alias("_c"), entry.alias("entry"))
    # Five tests as one array: bounded by the feature itself.
    asked = few.agg(F.collect_list(F.struct(
        "test_id", F.trim(F.lower("category")).alias("cat"), F.transform("titles", F.lower).alias("titles"))).alias("_tests"))
    hits = F.filter("_tests", lambda t: (
        F.exists(t["titles"], lambda s: (F.length(s) > 0) & (F.instr(F.col("_t"), s) > 0) | (s == F.col("_t")))
        | ((F.length(t["cat"]) > 0) & (t["cat"] == F.col("_c")))))
    prio = a.withColumn("_tests", asked.scalar()).select(order, "confidence", "entry", F.explode(hits).alias("t")).select(
        F.col("t.test_id").alias("test_id"), order, "entry")
    prio = top_rows(prio, ["test_id"], [F.col(order)], most, "_r").select(
        "test_id", "entry", F.lit(0).alias("_p"), F.lit(0.0).alias("_s"), order)
    # The rest by confidence: enough rows to outlast those that are priority for a test.
    best = a.orderBy(F.col("confidence").desc(), order).limit(2 * most)
    ids = few.agg(F.collect_list("test_id").alias("t")).scalar()
    rest = best.withColumn("test_id", F.explode(ids)).join(prio.select("test_id", order), ["test_id", order], "left_anti").select(
        "test_id", "entry", F.lit(1).alias("_p"), (-F.col("confidence")).alias("_s"), order)
    both = top_rows(prio.unionByName(rest), ["test_id"], [F.col("_p"), F.col("_s"), F.col(order)], most, "pos")
    w = W.partitionBy("test_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("_sum", F.sum(F.length("entry")).over(w)).filter(F.col("_sum") <= CONTEXT_CHARS).select("test_id", "pos", "entry")


INLINE_CHARS = 50_000


REFERENCES_CUT = "\n\n*[References truncated to fit size limit]*"


def _fitted(rows: DataFrame, order: str, text: str, budget: Column) -> DataFrame:
    """(ord, text, is_cut): the texts, two characters apart, that lie within ``budget``, the last one cut.

    Rows stay rows; positions come from a running sum that no single task computes.
    """
    r = rows.filter(F.length(text) > 0).select(F.col(order).alias("ord"), F.col(text).alias("text"))
    placed = running_total(r, [F.col("ord")], F.length("text") + 2, "_end")
    start = F.col("_end") - F.length("text") - 2
    kept = placed.withColumn("_left", (budget - start).cast("int")).filter(F.col("_left") > 0)
    return kept.select("ord", F.left("text", F.col("_left")).alias("text"), (F.col("_left") < F.length("text")).alias("is_cut"))


def _total(rows: DataFrame, text: str) -> Column:
    """Characters of all texts, two apart, as a scalar."""
    filled = rows.filter(F.length(text) > 0)
    return filled.agg(F.coalesce(F.sum(F.length(text) + 2) - 2, F.lit(0)).alias("t")).scalar()


def _knowledge_chars(knowledge: DataFrame, text: str, overhead: int) -> Column:
    return knowledge.agg((F.coalesce(F.sum(F.length(text) + 1), F.lit(0)) + overhead).alias("u")).scalar()


def _reference_chars(used: Column, total: Column, limit: int) -> Column:
    return F.when(used + total > limit, F.greatest(limit - used - 200, F.lit(0))).otherwise(total)


def inline_references(knowledge: DataFrame, refs: DataFrame, order: str, text: str, overhead: int = 0, limit: int = INLINE_CHARS) -> DataFrame:
    """(ord, text, is_cut): references that fit beside the knowledge text, the last one cut."""
    used, total = _knowledge_chars(knowledge, text, overhead), _total(refs, text)
    return _fitted(refs, order, text, _reference_chars(used, total, limit))


def inline_examples(used: Column, total: Column, limit: int = INLINE_CHARS) -> Column:
    """Characters of example text that go in: all, a cut, or none."""
    room = limit - used
    return F.when(used + total < limit, total).when(room > 1000, F.least(total, room - 200)).otherwise(0)


def inline_document(knowledge: DataFrame, refs: DataFrame, examples: DataFrame, order: str, text: str, overhead: int = 0, limit: int = INLINE_CHARS) -> DataFrame:
    """(part, ord, text, is_cut): references, then code examples in what room they leave."""
    used, total = _knowledge_chars(knowledge, text, overhead), _total(refs, text)
    inlined = _reference_chars(used, total, limit)
    after = used + inlined + F.when(used + total > limit, len(REFERENCES_CUT)).otherwise(0)
    budget = inline_examples(after, _total(examples, text), limit)
    return _fitted(refs, order, text, inlined).select(F.lit("reference").alias("part"), "*").unionByName(
        _fitted(examples, order, text, budget).select(F.lit("example").alias("part"), "*"))


def lint_document(description: Column, body: Column) -> Column:
    """Warnings for description length and body lines outside front matter."""
    words = T.word_count(description)
    state = F.aggregate(
        T.lines(body), F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")),
        lambda s, line: F.when(T.strip(line) == "---", F.struct((~s["inside"]).alias("inside"), s["n"].alias("n"))).otherwise(
            F.struct(s["inside"].alias("inside"), (s["n"] + F.when(s["inside"], 0).otherwise(1)).alias("n"))))
    return F.filter(F.array(
        F.when(F.length(description) > 1024, "description over 1024 characters"),
        F.when(words > 200, "description over 200 words"),
        F.when(words < 50, "description under 50 words"),
        F.when(state["n"] > 500, "body over 500 lines"),
    ), lambda x: x.isNotNull())


def lint_knowledge(body: Column) -> Column:
    toc = body.contains("## Table of Contents") | body.contains("## Mục lục")
    return (F.size(T.lines(body)) > 300) & ~toc


def domain_lessons(feedback: DataFrame, domain: str, order: str, k: int = 5) -> DataFrame:
    """Latest ``k`` non-empty remarks per domain with mean rating."""
    said = feedback.filter(F.length(F.coalesce("feedback", F.lit(""))) > 0)
    top = top_rows(said, [domain], [F.col(order).desc()], k, "_r")
    issues = F.coalesce(F.array_join(F.from_json("issues", "array<string>"), ", "), F.lit("none"))
    line = F.format_string("%d. Rating: %d/5 | Issues: %s\n   %s", F.col("_r"), F.col("rating"), issues, F.col("feedback"))
    return top.groupBy(domain).agg(
        F.avg("rating").alias("avg_rating"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"]), "\n").alias("lessons"))


def baseline_status(domains: DataFrame, baselines: DataFrame, domain: str, order: str) -> DataFrame:
    """ready, pending or none from the latest baseline of each domain."""
    last = latest(baselines, [domain], F.col(order))
    joined = domains.join(last, domain, "left")
    ready = (F.col("status") == "ready") & F.col("path").isNotNull()
    return joined.select(
        *domains.columns, F.when(F.col("status").isNull(), "none").when(ready, "ready").otherwise("pending").alias("baseline"),
        F.when(ready, F.col("refs_count")).otherwise(0).alias("refs_count"))


def overall_progress(phase: Column, progress: Column, phases: int = 7) -> Column:
    """Percent over all phases; phases are named p0, p1, ..."""
    rank = F.substring(phase, 2, 1).cast("int")
    return F.when(phase.isNull(), 0).otherwise(F.floor(rank * (100 / phases) + progress / 100 * (100 / phases) + 0.5)).cast("int")


def duration(start: Column, end: Column) -> Column:
    s = F.unix_timestamp(end) - F.unix_timestamp(start)
    mins = F.floor(s / 60).cast("int")
    return (F.when(start.isNull(), "—").when(mins > 60, F.format_string("%dh %dm", F.floor(mins / 60).cast("int"), mins % 60))
            .otherwise(F.format_string("%dm %ds", mins, (s % 60).cast("int"))))


def age(then: Column, now: Column) -> Column:
    """Largest whole unit since ``then``; the labels are fixed values."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    days, hours, mins = (F.floor(s / n).cast("int") for n in (86400, 3600, 60))
    return (F.when(days > 0, F.format_string("%d ngày trước", days)).when(hours > 0, F.format_string("%d giờ trước", hours))
            .when(mins > 0, F.format_string("%d phút trước", mins)).otherwise("vừa xong"))


def builds_listing(builds: DataFrame, status: str | None = None) -> DataFrame:
    """Newest first; 'all' or nothing lists every status."""
    kept = builds if not status or status == "all" else builds.filter(F.col("status") == status)
    return kept.orderBy(F.col("created_at").desc(), "id")


def templates_listing(templates: DataFrame) -> DataFrame:
    return templates.orderBy(F.col("is_default").desc(), F.col("usage_count").desc(), "id")


def log_page(logs: DataFrame, build: str, build_id, after: int = 0, limit: int | None = 500, level: str | None = None) -> DataFrame:
    """Log rows of a build after a cursor, in id order."""
    rows = logs.filter((F.col(build) == build_id) & (F.col("id") > after))
    if level and level != "all":
        rows = rows.filter(F.col("level") == level)
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def compare_builds(builds: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Two builds side by side; the description comes from the report, else the front matter."""
    from .sections import front_matter_field

    shown = F.coalesce("report_description", front_matter_field(F.col("document"), "description"), F.lit(""))
    b = builds.withColumn("description", shown).drop("report_description", "document")
    a = b.select(*[F.col(c).alias(f"a_{c}") for c in b.columns])
    o = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    return pairs.join(a, F.col("a") == F.col(f"a_{key}")).join(o, F.col("b") == F.col(f"b_{key}")).drop("a", "b")


def merge_chapters(chapters: DataFrame, book: str, name: str, text: str) -> DataFrame:
    """Numbered chapters of a book in one document, if it has at least two.

    Written as parts of about ``PART_CHARS`` characters; a book of any size is
    placed and gathered in pieces.
    """
    number = F.regexp_extract(name, r"(?i)^(\d{1,3})[\s._-]+(.+)\.pdf$", 1)
    body = T.strip(F.col(text))
    kept = chapters.withColumn("_n", number).filter(F.length("_n") > 0).select(
        book, F.col(name).alias("_name"), F.col("_n").cast("int").alias("_n"), body.alias("_body"))
    sizes = kept.groupBy(book).agg(F.count("*").alias("chapters")).filter(F.col("chapters") >= 2)
    part = F.concat(F.lit("\n--- "), "_name", F.lit(" ---\n\n"), "_body")
    slim = kept.filter(F.length("_body") > 0).select(book, "_n", "_name", part.alias("_part"))
    placed = running_total(slim, [F.col("_n"), F.col("_name")], F.length("_part") + 2, "_end", (book,))
    start = F.col("_end") - F.length("_part") - 2
    merged = placed.groupBy(book, F.floor(start / PART_CHARS).alias("part")).agg(
        T.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_end", "_part"))), lambda x: x["_part"]), "\n\n")).alias("merged"))
    return merged.join(sizes, book).select(book, "part", "chapters", "merged")
