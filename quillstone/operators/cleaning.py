"""Noise removal over the lines of a document, as array expressions.

A document never leaves its row: no explode, no shuffle, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import arrays, text as T

TOC_TITLE = rf"(?iu)^(table{T.WS}+of{T.WS}+contents|mục{T.WS}+lục|nội{T.WS}+dung)\z"
DOT_LEADER = rf"^.+\.{{3,}}{T.WS}*[0-9]+\z"
PAGE_NUMBER = (
    rf"(?iu)^{T.WS}*(?:[0-9]{{1,4}}|[-—]{T.WS}*[0-9]{{1,4}}{T.WS}*[-—]"
    rf"|(?:page|trang){T.WS}+[0-9]+|[0-9]+{T.WS}*/{T.WS}*[0-9]+){T.WS}*\z"
)


def _drop_repeats(lines: Column, times: int, shortest: int, below: int) -> Column:
    stripped = F.filter(
        F.transform(lines, T.strip), lambda s: (F.length(s) >= shortest) & (F.length(s) < below)
    )
    return arrays.let(
        arrays.repeated(stripped, times),
        lambda rep: F.filter(lines, lambda x: ~F.array_contains(rep, T.strip(x))),
    )


def drop_headers_footers(lines: Column) -> Column:
    """Drop lines of 2..99 characters that occur at least three times."""
    return _drop_repeats(lines, 3, 2, 100)


def drop_toc(lines: Column) -> Column:
    """Drop contents headings and dot-leader entries."""
    def noise(x: Column) -> Column:
        s = T.strip(x)
        return s.rlike(TOC_TITLE) | s.rlike(DOT_LEADER)

    return F.filter(lines, lambda x: ~noise(x))


def drop_blank_pages(text: Column) -> Column:
    """Drop form-feed segments with fewer than 50 visible characters."""
    segments = F.split(text, "\x0c", -1)
    return F.array_join(F.filter(segments, lambda s: F.length(T.strip(s)) >= 50), "\x0c")


def drop_page_numbers(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(PAGE_NUMBER))


def drop_watermarks(lines: Column) -> Column:
    """Drop lines under 80 characters that occur more than five times."""
    return _drop_repeats(lines, 6, 1, 80)


def merge_blanks(lines: Column) -> Column:
    """Keep the first of each run of blank lines."""
    def blank(x: Column) -> Column:
        return F.length(T.strip(x)) == 0

    return F.filter(
        lines, lambda x, i: ~(blank(x) & (i > 0) & F.coalesce(blank(F.get(lines, i - 1)), F.lit(False)))
    )


def normalise_whitespace(lines: Column) -> Column:
    return F.transform(lines, lambda x: T.rstrip(F.replace(x, F.lit("\t"), F.lit("    "))))


STEPS = (
    ("header_footer", drop_headers_footers),
    ("toc", drop_toc),
    ("page_numbers", drop_page_numbers),
    ("watermarks", drop_watermarks),
    ("merge_blanks", merge_blanks),
    ("normalize_ws", normalise_whitespace),
)


def split_lines(c: Column) -> Column:
    """Lines of a text, at least one: an empty text is one empty line."""
    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(T.splitlines(c))


def clean(
    df: DataFrame, text: str = "text", out: str = "cleaned", enabled: bool = True,
    form_feed: bool = False, blank: bool = False,
) -> DataFrame:
    """Add the cleaned text and a ``clean_stats`` struct, one row in, one row out.

    Blank text passes through, unless ``blank`` has it cleaned too.  ``form_feed`` also removes blank pages, which
    needs the raw text because line splitting consumes form feeds.
    """
    src = F.col(text)
    active = F.lit(enabled) & (F.lit(blank) | (F.length(T.strip(src)) > 0))
    raw = drop_blank_pages(src) if form_feed else src
    split = split_lines if blank else T.splitlines
    work = df.withColumn("_l0", split(src)).withColumn("_l1", split(raw))
    last, flags = "_l1", []
    if form_feed:
        flags.append(F.when(F.col("_l0") != F.col("_l1"), F.lit("blank_pages")))
    for i, (label, step) in enumerate(STEPS, start=2):
        work = work.withColumn(f"_l{i}", step(F.col(last)))
        flags.append(F.when(F.col(last) != F.col(f"_l{i}"), F.lit(label)))
        last = f"_l{i}"
    work = work.withColumn("_text", T.strip(F.array_join(last, "\n")))
    before, after = F.size("_l0"), F.size(last)
    done = F.struct(
        before.alias("original_lines"),
        after.alias("cleaned_lines"),
        (before - after).alias("removed_lines"),
        F.length(src).alias("original_chars"),
        F.length("_text").alias("cleaned_chars"),
        F.filter(F.array(*flags), lambda s: s.isNotNull()).alias("steps_applied"),
    )
    untouched = F.struct(
        before.alias("original_lines"),
        before.alias("cleaned_lines"),
        F.lit(0).alias("removed_lines"),
        F.length(src).alias("original_chars"),
        F.length(src).alias("cleaned_chars"),
        F.array().cast("array<string>").alias("steps_applied"),
    )
    work = work.withColumn(out, F.when(active, F.col("_text")).otherwise(src)).withColumn(
        "clean_stats", F.when(active, done).otherwise(untouched)
    )
    return work.drop("_text", *[f"_l{i}" for i in range(len(STEPS) + 2)])


def clean_summary(stats: Column) -> Column:
    """One-line summary of a ``clean_stats`` struct."""
    pct = F.when(
        stats["original_lines"] > 0, stats["removed_lines"] / stats["original_lines"] * 100
    ).otherwise(F.lit(0.0))
    return F.when(F.size(stats["steps_applied"]) == 0, F.lit("Clean: no noise detected")).otherwise(
        F.format_string(
            "Cleaned: removed %d lines (%.1f%%), saved ~%d chars. Steps: %s",
            stats["removed_lines"], pct, stats["original_chars"] - stats["cleaned_chars"],
            F.array_join(stats["steps_applied"], ", "),
        )
    )


@F.udf(StringType(), useArrow=False)
def nfc(text):
    """Canonical composition; Spark has no built-in for it.

    Whole texts go to Python in small batches; an Arrow batch holds 10,000 of them.
    """
    import unicodedata

    return None if text is None else unicodedata.normalize("NFC", text)


def sanitise_ocr(c: Column, compose: bool = True) -> Column:
    """Drop characters that break consumers, then tidy white space.

    The input is assumed to be valid UTF-8, as every Spark string is.
    """
    c = nfc(c) if compose else c
    unsafe = (
        r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{feff}\x{fffe}\x{fff0}-\x{ffff}"
        r"\x{e000}-\x{f8ff}\x{10000}-\x{10ffff}]"
    )
    c = F.regexp_replace(c, unsafe, "")
    # After the step above only these separators other than \n are left.
    c = F.regexp_replace(
        c, r"[\t\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "
    )
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r" +(?=\n|\z)", "")
    return T.strip(c)


def sanitise_request(c: Column, compose: bool = True) -> Column:
    """Variant for outgoing text: drops U+FFFD..U+FFFF and leaves white space alone."""
    c = nfc(c) if compose else c
    return F.regexp_replace(
        c,
        r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{feff}\x{fffd}-\x{ffff}\x{e000}-\x{f8ff}"
        r"\x{10000}-\x{10ffff}]",
        "",
    )


def diagnose(c: Column) -> Column:
    """Struct of character-class counts, control-character map and first ten findings."""
    def count(cls: str) -> Column:
        return F.regexp_count(c, F.lit(cls)).cast("int")

    control = r"([\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f])"
    found = F.regexp_extract_all(c, F.lit(control), 1)
    per_char = F.map_from_entries(
        F.transform(
            arrays.runs(found),
            lambda r: F.struct(
                F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(r["v"])), 2, "0"))).alias("k"),
                r["n"].alias("n"),
            ),
        )
    )
    # Only the first ten findings are looked up, so positions come from one scan of the row.
    marked = r"([\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{10000}-\x{10ffff}])"
    chars = F.split(F.when(c.rlike(marked), c), "")
    samples = F.slice(
        F.filter(
            F.transform(chars, lambda ch, i: F.struct(ch.alias("ch"), i.alias("at"))),
            lambda s: s["ch"].rlike(marked),
        ),
        1, 10,
    )
    return F.struct(
        F.length(c).alias("length"),
        c.contains("\x00").alias("has_null"),
        c.contains("\ufeff").alias("has_bom"),
        per_char.alias("control_chars"),
        count(r"[\x{10000}-\x{10ffff}]").alias("non_bmp_count"),
        F.lit(0).alias("surrogate_count"),
        count(r"\x{fffd}").alias("replacement_char_count"),
        count(r"[\x{e000}-\x{f8ff}]").alias("pua_count"),
        F.coalesce(
            F.transform(
                samples,
                lambda s: F.when(
                    F.ascii(s["ch"]) > 0xFFFF,
                    F.format_string("Non-BMP U+%04X at pos %d", F.ascii(s["ch"]), s["at"]),
                ).when(
                    F.ascii(s["ch"]) >= 0x7F,
                    F.format_string("C1 control \\x%02x at pos %d", F.ascii(s["ch"]), s["at"]),
                ).otherwise(
                    F.format_string("Control \\x%02x at pos %d", F.ascii(s["ch"]), s["at"])
                ),
            ),
            F.array().cast("array<string>"),
        ).alias("sample_problems"),
    )


def repair_page(c: Column) -> Column:
    """Join words hyphenated over a line break, drop digit-only lines."""
    c = F.regexp_replace(c, rf"({T.WORD})-\n({T.WORD})", "$1$2")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?md)^\s*\d+\s*$", "")
    return T.strip(c)


def heading_level(c: Column, font_size: Column | None = None) -> Column:
    """0..3: capitals 1, title case 2, then font size when it is known."""
    line = T.strip(c)
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    # Title case: a cased letter is upper after a non-letter and lower after a letter.
    titled = (
        line.rlike(r"\p{Lu}")
        & ~line.rlike(r"(?:^|[^\p{L}])\p{Ll}")
        & ~line.rlike(r"\p{L}\p{Lu}")
    )
    level = (
        F.when((F.length(line) == 0) | (F.length(line) > 100), 0)
        .when(upper & (F.length(line) > 3), 1)
        .when(titled & ~line.rlike(r"[.,;:?!]\z") & (F.length(line) < 60), 2)
    )
    if font_size is not None:
        level = level.when(font_size > 16, 1).when(font_size > 13, 2)
    return level.otherwise(0)


def find_header_footer(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Per document the first and last line shared by more than half of its pages.

    Counts are combined per (document, line) first, so one long document is
    spread over its distinct lines.
    """
    body = F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda s: F.length(s) > 0)
    edges = pages.select(
        doc, page, F.get(body, F.lit(0)).alias("top"), F.get(body, F.size(body) - 1).alias("bottom")
    )
    n_pages = pages.groupBy(doc).agg(F.count("*").alias("n_pages"))
    sides = edges.select(doc, page, F.explode(F.array(
        F.struct(F.lit("header").alias("side"), F.col("top").alias("line")),
        F.struct(F.lit("footer").alias("side"), F.col("bottom").alias("line")),
    )).alias("e")).select(doc, page, "e.side", "e.line").filter(F.col("line").isNotNull())
    common = (
        sides.groupBy(doc, "side", "line")
        .agg(F.count("*").alias("n"), F.min(page).alias("first_page"))
        .groupBy(doc, "side")
        .agg(F.max_by(F.struct("line", "n"), F.struct("n", -F.col("first_page"))).alias("best"))
    )
    flat = common.groupBy(doc).agg(
        F.max(F.when(F.col("side") == "header", F.col("best"))).alias("h"),
        F.max(F.when(F.col("side") == "footer", F.col("best"))).alias("f"),
    )
    enough = F.col("n_pages") >= 3

    def accepted(side: str) -> Column:
        return F.coalesce(
            F.when(enough & (F.col(f"{side}.n") > F.col("n_pages") * 0.5), F.col(f"{side}.line")),
            F.lit(""),
        )

    return n_pages.join(flat, doc, "left").select(
        doc, "n_pages", accepted("h").alias("header"), accepted("f").alias("footer")
    )


def remove_header_footer(text: Column, header: Column, footer: Column) -> Column:
    """First occurrence of the header and last of the footer are cut out."""
    at = F.instr(text, header)
    cut = F.when(
        (F.length(header) > 0) & (at > 0),
        F.concat(F.substring(text, F.lit(1), at - 1),
                 F.substring(text, at + F.length(header), F.length(text))),
    ).otherwise(text)
    cut = F.when(F.length(header) > 0, T.strip(cut)).otherwise(cut)

    def tail(t: Column) -> Column:
        back = F.instr(F.reverse(t), F.reverse(footer))
        start = F.length(t) - back - F.length(footer) + 1
        return F.when(
            (F.length(footer) > 0) & (back > 0),
            F.concat(F.substring(t, F.lit(1), start),
                     F.substring(t, start + F.length(footer) + 1, F.length(t))),
        ).otherwise(t)

    return T.strip(arrays.let(cut, tail))


MAX_PAGES = 500


def assemble_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """One Markdown document per ``doc`` from its first 500 pages (the format's page limit).

    At most ``MAX_PAGES`` rows per document are gathered.
    """
    marks = find_header_footer(pages.filter(F.col(page) < MAX_PAGES), doc, page, text)
    totals = pages.groupBy(doc).agg(F.count("*").alias("_total"))
    repaired = (
        pages.filter(F.col(page) < MAX_PAGES)
        .join(marks, doc)
        .withColumn("_body", repair_page(remove_header_footer(F.col(text), F.col("header"), F.col("footer"))))
        .filter(F.length("_body") > 0)
    )

    def mark(line: Column) -> Column:
        return arrays.let(
            heading_level(line),
            lambda h: F.when(
                h > 0,
                F.concat(F.lit("\n"), F.repeat(F.lit("#"), (h + 1).cast("int")), F.lit(" "),
                         T.strip(line), F.lit("\n")),
            ).otherwise(line),
        )

    md = F.concat(
        F.lit("## Page "), (F.col(page) + 1).cast("string"), F.lit("\n\n"),
        F.array_join(F.transform(T.lines(F.col("_body")), mark), "\n"), F.lit("\n"),
    )
    joined = repaired.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), md.alias("md")))).alias("parts")
    )
    body = T.strip(F.array_join(F.transform("parts", lambda x: x["md"]), "\n"))
    note = F.when(
        F.col("_total") > MAX_PAGES,
        F.format_string("\n\n*[Truncated: showing %d of %d pages]*", F.lit(MAX_PAGES), F.col("_total")),
    ).otherwise("")
    return joined.join(totals, doc).select(doc, F.concat(body, note).alias("markdown"))
