"""Scalar text functions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import arrays

# The whitespace removed by a Unicode-aware strip.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
WS_SET = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
# The same characters for Java's matcher, which tests the members in order: most are settled by the first.
_IN_WORD = f"[!-~{NOT_WS}]"
WORD = r"[\p{L}\p{N}_]"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
LINE_BREAK = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def simple_case(c: Column) -> Column:
    """The letters whose lower case is not one letter of its own, or depends on what follows, lower-cased alone."""
    return F.translate(c, "\u0130\u03a3", "i\u03c3")


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """True if any needle occurs; one alternation pass over the text."""
    quoted = "|".join("\\Q" + n + "\\E" for n in needles)
    return c.rlike(quoted)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def splitlines(c: Column) -> Column:
    """Lines under every Unicode line break; a final break opens no empty line."""
    unified = F.regexp_replace(F.regexp_replace(c, LINE_BREAK, "\n"), r"\n\z", "")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(lines(unified))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_IN_WORD + "++"))


def words(c: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(c, F.lit(f"({_IN_WORD}++)"), 1)


def first_word(c: Column) -> Column:
    """The first whitespace-separated word, null without one; the rest of the text is not searched."""
    return F.nullif(F.regexp_extract(c, _IN_WORD + "++", 0), F.lit(""))


def tokens(c: Column, shortest: int = 3) -> Column:
    """Maximal runs of word characters, lower-cased, at least ``shortest`` long."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}{{{shortest},}})"), 1)


def _meaningful(stop: tuple[str, ...], longest: int | None):
    """Test for one token: no number, no stop word, not too long."""
    def keep(t: Column) -> Column:
        ok = ~t.rlike(r"^\p{Nd}+$")
        if longest:
            ok = ok & (F.length(t) <= longest)
        return ok & ~t.isin(*stop) if stop else ok  # a set of literals is looked up, not scanned

    return keep


def keywords(
    c: Column, k: int, stop: tuple[str, ...] = (), shortest: int = 3, longest: int | None = None
) -> Column:
    """Top ``k`` keywords by frequency, ties by first occurrence."""
    return arrays.top_by_count(tokens(c, shortest), k, _meaningful(stop, longest))


def keyword_set(c: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.filter(F.array_distinct(tokens(c)), _meaningful(stop, None))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1))


def overlap(a: Column, b: Column) -> Column:
    """|A and B| / min(|A|, |B|); 0 when either side is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix, clamped to [0, 1]; 0 for an empty or zero vector."""
    def dot(x: Column, y: Column) -> Column:
        terms = F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0)).cast("double"))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0) & (norms > 0),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms)),
    ).otherwise(F.lit(0.0))


def has_negation(c: Column, negations: tuple[str, ...], word_match: bool = False) -> Column:
    """Negation by substring; ``word_match`` asks for whole words instead."""
    low = F.lower(c)
    if not word_match:
        return contains_any(low, negations)
    body = "|".join("\\Q" + n + "\\E" for n in negations)
    return low.rlike(rf"(?<!{WORD})(?:{body})(?!{WORD})")


def content_key(*parts: Column, length: int = 16) -> Column:
    """Leading hex digits of the sha-256 of the parts joined with ':'."""
    joined = parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)
    return F.left(F.sha2(joined.cast("binary"), 256), F.lit(length))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def page_count(c: Column, words: Column | None = None) -> Column:
    """Page markers if any, else one page per 500 words, at least one; ``words`` is their number if it is known."""
    marks = F.regexp_count(c, F.lit(r"\Q## Page \E"))
    return F.when(marks > 0, marks).otherwise(
        F.greatest(F.lit(1), F.floor((word_count(c) if words is None else words) / 500).cast("int"))
    )


def ends_sentence(c: Column) -> Column:
    return rstrip(c).rlike("[.!?。…]\\z")


def noted_score(note: Column) -> Column:
    """Number after the word ``score``; null when it is not a number."""
    return F.regexp_extract(note, rf"score{WS}+([0-9.]+)", 1).try_cast("double")


def snippet(text: Column, needles: Column, context: int = 200) -> Column:
    """struct<snippet, start, end> around the first needle (in list order) that occurs."""
    # The lowered text is bound once, not once per needle.
    hits = arrays.let(
        F.lower(text),
        lambda low: F.filter(F.transform(needles, lambda n: F.instr(low, n) - 1), lambda p: p >= 0),
    )
    size = F.length(text)

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - context)
        end = F.least(size, at + context)
        body = strip(F.substring(text, start + 1, end - start))
        return F.struct(
            F.concat(
                F.when(start > 0, "...").otherwise(""), body, F.when(end < size, "...").otherwise("")
            ).alias("snippet"),
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
        )

    head = F.struct(
        F.left(text, F.lit(context)).alias("snippet"),
        F.lit(0).alias("start"),
        F.least(size, F.lit(context)).cast("int").alias("end"),
    )
    return arrays.let(F.get(hits, F.lit(0)), lambda at: F.when(at.isNull(), head).otherwise(cut(at)))


def cut_at_sentence(c: Column, limit: int) -> Column:
    """Cut at ``limit``, back to the last sentence end beyond half of it, else the last space."""
    head = F.left(c, F.lit(limit))
    out = F.when(F.length(c) <= limit, c)

    def last(sep: str) -> Column:
        from_end = F.instr(F.reverse(head), F.lit(sep[::-1]))
        return F.when(from_end > 0, F.length(head) - from_end - len(sep) + 1).otherwise(-1)

    for sep in (". ", ".\n", "? ", "!\n", "! "):
        at = last(sep)
        out = out.when(at > limit * 0.5, rstrip(F.left(head, (at + 1).cast("int"))))
    space = last(" ")
    return out.when(space > limit * 0.5, rstrip(F.left(head, space.cast("int")))).otherwise(rstrip(head))
