"""Sections, titles and plain text out of HTML and Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from ..functions import constants as K, text as T

BOILERPLATE = r"(?is)<(script|style|nav|footer|header)[^>]*>.*?</\1>"
HEADING_LINE = r"^(#{1,3})[^\S\n]+(.+)"
MAX_CONTENT = 50_000


# --- HTML: the tag walk is the only Python; everything after it is DataFrame code ----------------

_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed"}
_BLOCK = {
    "p", "div", "ul", "ol", "pre", "table", "blockquote", "section", "article", "main",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "aside",
}


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.kids = tag, dict(attrs), []

    def walk(self):
        for k in self.kids:
            if isinstance(k, _Node):
                yield k
                yield from k.walk()

    def text(self, strip=True):
        parts = []
        for k in self.kids:
            parts.append(k.text(strip) if isinstance(k, _Node) else (k.strip() if strip else k))
        return "".join(parts)


class _Tree(HTMLParser):
    """Minimal element tree; an open paragraph ends at the next block element."""

    def __init__(self, html, dropped):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root")
        self.stack, self.dropped, self.muted = [self.root], dropped, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.muted or tag in self.dropped:
            self.muted += tag not in _VOID
            return
        if tag in _BLOCK and any(n.tag == "p" for n in self.stack):
            self.handle_endtag("p")
        node = _Node(tag, attrs)
        self.stack[-1].kids.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        if not self.muted and tag not in self.dropped:
            self.stack[-1].kids.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        if self.muted:
            self.muted -= tag not in _VOID
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.muted:
            self.stack[-1].kids.append(data)


def _pick(root, tests):
    for test in tests:
        for node in root.walk():
            if test(node):
                return node
    return next((n for n in root.walk() if n.tag == "body"), root)


def _classes(node):
    return (node.attrs.get("class") or "").split()


def _children_rows(frames, key, html):
    import re

    import pandas as pd

    dropped = {"script", "style", "nav", "footer", "header", "aside"}
    named = re.compile("content|body|main")
    tests = (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: n.tag == "div" and any(named.search(c) for c in _classes(n)),
    )
    for frame in frames:
        rows = []
        for k, page in zip(frame[key], frame[html]):
            main = _pick(_Tree(page or "", dropped).root, tests)
            for i, kid in enumerate(main.kids):
                is_node = isinstance(kid, _Node)
                level = int(kid.tag[1]) if is_node and kid.tag in ("h1", "h2", "h3") else 0
                rows.append((k, i, level, kid.text() if is_node else kid.strip()))
        yield pd.DataFrame(rows, columns=[key, "pos", "level", "text"])


def html_sections(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Sections of the main element, split at its h1-h3 children.

    Columns: key, url, section, title, content, section_path, entry_id,
    keywords, content_hash.  Sections under 50 characters are dropped.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, pos int, level int, text string"
    kids = pages.select(key, html).mapInPandas(lambda it: _children_rows(it, key, html), schema)
    # A page's direct children: bounded by one page.
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = kids.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))
    per_page = marked.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("level") > 0, F.struct(
            "pos", "level", F.coalesce(F.nullif("text", F.lit("")), F.lit("Untitled")).alias("title")
        )))).alias("heads"),
        F.sort_array(F.collect_list(F.when((F.col("level") == 0) & (F.length("text") > 0), F.struct(
            "pos", "section", "text")))).alias("body"),
    )
    section = F.explode(F.array_distinct(F.transform("body", lambda b: b["section"])))
    cut = per_page.select(key, "heads", "body", section.alias("section"))
    content = T.strip(F.array_join(F.transform(
        F.filter("body", lambda b: b["section"] == F.col("section")), lambda b: b["text"]), "\n"))
    path = F.aggregate(
        F.slice("heads", F.lit(1), F.col("section")),
        F.array(F.lit("Introduction")),
        lambda acc, h: F.concat(F.slice(acc, F.lit(1), h["level"] - 1), F.array(h["title"])),
    )
    out = cut.select(
        key, "section", F.when(F.col("section") == 0, F.lit("Introduction")).otherwise(
            F.get("heads", F.col("section") - 1)["title"]).alias("title"),
        content.alias("content"), path.alias("section_path"),
    )
    return _as_entries(out.join(pages.select(key, url), key), url)


def _as_entries(sections: DataFrame, url: str) -> DataFrame:
    return sections.filter(F.length("content") >= 50).select(
        "*",
        F.concat(F.lit("bl_"), T.content_key(F.concat(url, "title"), length=10)).alias("entry_id"),
        T.keywords(F.col("content"), 10, tuple(K.STOP_PARSER)).alias("keywords"),
        T.content_key(F.col("content")).alias("content_hash"),
    )


def _markdown(page: str | None) -> str:
    """Markdown of one page."""
    dropped = {"nav", "header", "footer", "script", "style", "noscript"}
    noise = {"sidebar", "advertisement", "ads", "cookie-banner", "popup", "social-share", "comments"}
    tests = (
        lambda n: n.tag == "article",
        lambda n: n.attrs.get("role") == "main",
        lambda n: n.tag == "main",
        lambda n: "post-content" in _classes(n),
        lambda n: "article-body" in _classes(n),
        lambda n: "entry-content" in _classes(n),
        lambda n: n.attrs.get("id") == "content",
        lambda n: "content" in _classes(n),
    )
    root = _Tree(page or "", dropped).root
    _drop(root, noise)
    lines: list[str] = []
    _render(_pick(root, tests), lines)
    return "\n".join(lines)


def _drop(node, noise):
    node.kids = [k for k in node.kids if not (isinstance(k, _Node) and noise & set(_classes(k)))]
    for k in node.kids:
        if isinstance(k, _Node):
            _drop(k, noise)


_WRAP = {"strong": "**{}**", "b": "**{}**", "em": "*{}*", "i": "*{}*", "code": "`{}`"}


def _inline(node) -> str:
    out = []
    for k in node.kids:
        if not isinstance(k, _Node):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif k.tag == "a":
            out.append(f"[{k.text()}]({k.attrs.get('href') or ''})")
        else:
            out.append(_WRAP.get(k.tag, "{}").format(k.text()))
    return " ".join(out).strip()


def _render(node, lines) -> None:
    tag, block = node.tag, None
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        block = [f"{'#' * int(tag[1])} {node.text()}"] if node.text() else []
    elif tag == "p":
        block = [_inline(node)] if _inline(node) else []
    elif tag in ("ul", "ol"):
        items = [_inline(k) for k in node.kids if isinstance(k, _Node) and k.tag == "li"]
        marks = (f"{i}." if tag == "ol" else "-" for i in range(1, len(items) + 1))
        block = [f"{m} {t}" for m, t in zip(marks, items) if t]
    elif tag == "pre":
        code = next((n for n in node.walk() if n.tag == "code"), node)
        block = ["```", code.text(strip=False).strip(), "```"]
    elif tag == "table":
        grid = [[c.text().replace("|", "\\|") for c in r.walk() if c.tag in ("th", "td")]
                for r in node.walk() if r.tag == "tr"]
        rows = ["| " + " | ".join(r) + " |" for r in grid]
        block = rows[:1] + ["| " + " | ".join(["---"] * len(grid[0])) + " |"] + rows[1:] if grid else []
    elif tag == "blockquote":
        block = [f"> {t}" for t in node.text().split("\n")] if node.text() else []
    elif tag == "img":
        if node.attrs.get("alt") or node.attrs.get("src"):
            lines.append(f"![{node.attrs.get('alt') or ''}]({node.attrs.get('src') or ''})")
        return
    if block is not None:
        lines.extend(["", *block, ""] if block else [])
        return
    for k in node.kids:
        if isinstance(k, _Node):
            _render(k, lines)
        elif k.strip():
            lines.append(k.strip())


def html_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown, truncated) per page with at least 50 characters; cut at 50,000."""
    # Whole pages go to Python in small batches, as an Arrow batch holds 10,000 of them; the filter below must not walk them again.
    walk = F.udf(_markdown, StringType(), useArrow=False).asNondeterministic()
    walked = pages.select(key, walk(html).alias("markdown"))
    tidy = walked.withColumn("markdown", T.strip(F.regexp_replace("markdown", r"\n{3,}", "\n\n")))
    return tidy.filter(F.length("markdown") >= 50).select(
        key, limit_content(F.col("markdown"), MAX_CONTENT, "\n\n*[Content truncated]*").alias("markdown"),
        (F.length("markdown") > MAX_CONTENT).alias("truncated"),
    )


def limit_content(c: Column, limit: int, note: str) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(note))).otherwise(c)


def html_text(html: Column) -> Column:
    """Visible text: boilerplate blocks out, tags to line breaks."""
    bare = F.regexp_replace(F.regexp_replace(html, BOILERPLATE, ""), "<[^>]+>", "\n")
    return T.strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def page_title(html: Column) -> Column:
    title = T.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = T.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), F.lit("Untitled"))


# --- Markdown ------------------------------------------------------------------------------------


def markdown_sections(docs: DataFrame, url: str, text: str) -> DataFrame:
    """Sections split at #, ## and ### lines, inside the row until the explode."""
    parts = F.split(text, r"\n(?=#{1,3}[^\S\n]+.)")
    body = docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("section", "_part"))
    # A heading opens its part or there is none.
    title = F.regexp_extract("_part", HEADING_LINE, 2)
    rest = F.when(F.length(title) > 0, F.regexp_replace("_part", r"^[^\n]*\n?", "")).otherwise(F.col("_part"))
    cut = body.select(
        *[c for c in body.columns if c != "_part"],
        F.when(F.length(title) > 0, T.strip(title)).otherwise("Introduction").alias("title"),
        T.strip(rest).alias("content"),
    )
    return _as_entries(cut, url)


def markdown_title(text: Column) -> Column:
    """First level-one heading or first line over five characters that is no rule."""
    kept = F.filter(
        F.transform(T.lines(text), T.strip),
        lambda s: s.startswith("# ") | ((F.length(s) > 5) & (s != "---")),
    )
    first = F.get(kept, F.lit(0))
    return F.coalesce(
        F.when(first.startswith("# "), T.strip(F.substr(first, F.lit(3)))).otherwise(first), F.lit("Untitled")
    )


def reference_title(text: Column, url: Column) -> Column:
    """First usable heading or line, cut at 120, else the prettified end of the URL path."""
    def heading(s: Column) -> Column:
        return s.startswith("#") & (F.length(T.strip(F.ltrim(s, F.lit("#")))) > 3)

    kept = F.filter(
        F.transform(T.lines(text), T.strip),
        lambda s: heading(s) | ((F.length(s) > 5) & ~s.startswith("---")),
    )
    first = F.get(kept, F.lit(0))
    from_text = F.left(F.when(heading(first), T.strip(F.ltrim(first, F.lit("#")))).otherwise(first), F.lit(120))
    last = F.element_at(F.split(F.btrim(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), "/"), -1)
    pretty = F.initcap(F.translate(F.try_url_decode(last), "-_", "  "))
    return F.coalesce(from_text, F.left(F.nullif(pretty, F.lit("")), F.lit(120)), F.lit(""))


def heading_topics(docs: DataFrame, group: str, ord_: str, text: str, given: DataFrame | None = None) -> DataFrame:
    """Distinct topics per group in order: given ones first, then ## and ### headings."""
    def is_topic(s: Column) -> Column:
        return s.startswith("## ") | s.startswith("### ")

    heads = F.filter(F.transform(T.lines(F.col(text)), T.strip), is_topic)
    found = docs.select(group, F.col(ord_).alias("ord"), F.posexplode(heads).alias("pos", "line")).select(
        group, F.struct(F.lit(1).alias("part"), "ord", "pos").alias("at"),
        T.strip(F.regexp_replace("line", r"^#+\s*", "")).alias("topic"),
    )
    if given is not None:
        first = given.select(group, F.struct(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"),
                                             F.lit(0).alias("pos")).alias("at"), "topic")
        found = first.unionByName(found)
    return found.filter(F.length("topic") > 0).groupBy(group, "topic").agg(F.min("at").alias("at"))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)


def front_matter_field(text: Column, field: str) -> Column:
    """One field; folded and literal blocks are joined on one line."""
    raw = F.regexp_extract(front_matter(text), rf"(?s)(?:^|\n){field}:[^\S\n]*(.*?)(?=\n\w|\z)", 1)
    return T.strip(F.regexp_replace(F.regexp_replace(raw, r"^[>|]\s*", ""), r"\n\s+", " "))


def strip_front_matter(text: Column) -> Column:
    return F.when(
        text.startswith("---") & (F.instr(F.substr(text, F.lit(4)), "---") > 0),
        T.strip(F.regexp_replace(text, r"(?s)^---.*?---", "")),
    ).otherwise(text)
