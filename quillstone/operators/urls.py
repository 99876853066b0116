"""URL lists, normalisation, filters and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, constants as K, text as T

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def parse_list(c: Column) -> Column:
    """Valid http(s) URLs of a comma- or newline-separated list, in order."""
    parts = F.transform(F.split(c, r"[,\n]+"), T.strip)
    return F.filter(parts, lambda u: u.rlike(r"^https?://[^/?#]+"))


def normalise(url: Column) -> Column:
    """scheme://host/path, lower case, without trailing slashes, query or fragment."""
    base = F.concat(
        F.regexp_extract(url, SCHEME, 1), F.lit("://"), F.regexp_extract(url, HOST, 1),
        F.rtrim(path(url), F.lit("/")),
    )
    return F.lower(base)


def is_scripted(url: Column) -> Column:
    """Host on the fixed list of script-rendered sites."""
    return host(url).isin(*K.SCRIPTED_HOSTS)


def excluded(url: Column, patterns: tuple[str, ...]) -> Column:
    return T.contains_any(F.lower(url), patterns)


def matches(url: Column, patterns: tuple[str, ...]) -> Column:
    """Any pattern occurs; no patterns match everything."""
    return T.contains_any(url, patterns) if patterns else F.lit(True)


def source_type(url: Column) -> Column:
    return (
        F.when(url.contains("github.com"), "github")
        .when(url.contains("developers.facebook.com"), "api_docs")
        .when(url.contains("business/help"), "help_center")
        .otherwise("html")
    )


def safe_name(url: Column) -> Column:
    """File name from the path: at most 80 of [A-Za-z0-9-], 'page' when empty."""
    name = F.regexp_replace(
        F.replace(F.btrim(path(url), F.lit("/")), F.lit("/"), F.lit("-")), "[^a-zA-Z0-9-]", ""
    )
    return F.coalesce(F.nullif(F.left(name, F.lit(80)), F.lit("")), F.lit("page"))


def fold_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; it starts with a slash."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda seen, p: F.when(p == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .when(p == ".", seen).otherwise(F.array_append(seen, p)))
    whole = F.concat(F.array_join(folded, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole))


def resolve(base: dict[str, Column], link: Column) -> Column:
    """``link`` as seen from a page; ``base`` has the page's ``url``, ``scheme``, ``root`` and ``path``.

    Links of another scheme stay as they are.  A relative path starts at the page's folder,
    empty segments inside it are dropped; a query or fragment alone keeps the page's path.
    """
    tail = F.regexp_extract(link, r"([?#].*)?\z", 0)
    place = F.regexp_extract(link, r"^[^?#]*", 0)
    folder = F.regexp_replace(base["path"], r"[^/]*\z", "")
    joined = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), place), r"(?<=.)/{2,}|(?<=/)/+", "/")
    return (
        F.when(link == "", base["url"])
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(base["scheme"], F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base["url"], "(?s)#.*", ""), link))
        .when(place == "", F.concat(base["root"], base["path"], tail))
        .when(place.startswith("/"), F.concat(base["root"], fold_dots(place), tail))
        .otherwise(F.concat(base["root"], fold_dots(joined), tail))
    )


def page_links(
    pages: DataFrame, url: str, html: str, patterns: tuple[str, ...] = (), limit: int = 30
) -> DataFrame:
    """Internal links per page, first ``limit`` in document order (the crawl's own limit).

    Works inside the row: a page's links are an array until the final explode.
    """
    # Parts of the page's own URL are columns, so the link expressions do not repeat them.
    kept_columns = [c for c in pages.columns if c != html]
    pages = pages.withColumns({
        "_scheme": F.regexp_extract(url, SCHEME, 1), "_netloc": F.regexp_extract(url, HOST, 1), "_path": path(F.col(url)),
        "_root": F.concat(F.regexp_extract(url, SCHEME, 1), F.lit("://"), F.regexp_extract(url, HOST, 1)),
    })
    base = {"url": F.col(url), "scheme": F.col("_scheme"), "root": F.col("_root"), "path": F.col("_path")}
    hrefs = F.regexp_extract_all(html, F.lit(r'(?s)<a[^>]*href="([^"]*)"[^>]*>'), 1)
    kept = F.filter(hrefs, lambda h: ~(h.startswith("#") | h.startswith("mailto:")))
    same = F.filter(
        F.transform(kept, lambda h: resolve(base, h)),
        lambda u: (F.regexp_extract(u, HOST, 1) == F.col("_netloc")) & matches(u, patterns),
    )
    return pages.select(
        *kept_columns, F.posexplode(F.slice(same, 1, limit)).alias("pos", "link")
    )


def sitemap_links(
    sitemaps: DataFrame, roots: DataFrame, url: str, xml: str, patterns: tuple[str, ...] = (), limit: int = 50
) -> DataFrame:
    """(root, pos, link): page addresses of the stored sitemap of each root, first ``limit`` each.

    An index is followed one level: the addresses of its sitemaps come first, in their order,
    then the root's own.  A sitemap that is not stored, or is no XML of this kind, gives none.
    """
    loc = r"(?s)<{0}\b[^>]*>(?:(?!</{0}>).)*?<loc>\s*([^<]*?)\s*</loc>"
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    found = lambda tag: F.transform(F.regexp_extract_all(xml, F.lit(loc.format(tag)), 1), plain)
    read = sitemaps.select(F.col(url).alias("_map"), found("url").alias("_links"), found("sitemap").alias("_maps"))
    own = roots.select(F.col(url).alias("root")).join(read, F.col("root") == F.col("_map"))
    nested = (
        own.select("root", F.posexplode("_maps").alias("_m", "_sub"))
        .join(read.select(F.col("_map").alias("_sub"), "_links"), "_sub")
        .select("root", F.lit(0).alias("_level"), "_m", F.posexplode("_links").alias("_i", "link"))
    )
    direct = own.select("root", F.lit(1).alias("_level"), F.lit(0).alias("_m"), F.posexplode("_links").alias("_i", "link"))
    every = nested.unionByName(direct).filter(matches(F.col("link"), patterns))
    first = top_rows(every, ["root"], [F.col("_level"), F.col("_m"), F.col("_i")], limit, "pos")
    return first.select("root", (F.col("pos") - 1).alias("pos"), "link")


def distinct_candidates(candidates: DataFrame, url: str, ord_: str, limit: int = 100) -> DataFrame:
    """First occurrence per normalised URL, first ``limit`` overall (the report's own limit)."""
    rest = [c for c in candidates.columns]
    firsts = candidates.groupBy(normalise(F.col(url)).alias("normalised")).agg(
        F.min_by(F.struct(*rest), F.col(ord_)).alias("_row")
    )
    return firsts.select("normalised", *[F.col(f"_row.{c}").alias(c) for c in rest]).orderBy(ord_).limit(limit)


def rank_scored(candidates: DataFrame, scores: DataFrame, top: int = 15) -> DataFrame:
    """Candidates with model scores; a candidate without scores (failed batch) gets 5.0."""
    combined = F.when(
        F.col("relevance").isNotNull(),
        F.col("relevance") * 0.4 + F.col("quality") * 0.3 + F.col("authority") * 0.3,
    ).otherwise(5.0)
    return (
        candidates.join(scores, "url", "left")
        .withColumn("combined_score", combined)
        .orderBy(F.col("combined_score").desc(), "ord")
        .limit(top)
    )


def search_results_html(html: Column, limit: int = 15) -> Column:
    """array<struct<href, title, snippet>> of the first result anchors of a stored result page."""
    link = r'<a[^>]*class="result__a"[^>]*href="([^"]*)"[^>]*>'
    anchor = r'(?s)<a[^>]*class="result__a"[^>]*href="[^"]*"[^>]*>(.*?)</a>'
    note = r'(?s)<a[^>]*class="result__snippet"[^>]*>(.*?)</a>'
    hrefs = F.slice(F.regexp_extract_all(html, F.lit(link), 1), 1, limit)
    titles = F.regexp_extract_all(html, F.lit(anchor), 1)
    notes = F.regexp_extract_all(html, F.lit(note), 1)

    def plain(c: Column) -> Column:
        return T.strip(F.regexp_replace(c, "<[^>]+>", ""))

    return arrays.let(F.struct(titles.alias("t"), notes.alias("n")), lambda x: F.transform(
        hrefs,
        lambda h, i: F.struct(
            redirect_target(h).alias("url"),
            plain(F.get(x["t"], i)).alias("title"),
            F.coalesce(plain(F.get(x["n"], i)), F.lit("")).alias("snippet"),
        ),
    ))


def redirect_target(href: Column) -> Column:
    """URL behind a result redirect; empty when there is none."""
    inner = F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1)
    return (
        F.when(F.length(inner) > 0, F.try_url_decode(inner))
        .when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise("")
    )


def search_blocks(c: Column, limit: int = 5) -> Column:
    """Result blocks of a stored plain-text answer: array<struct<url, title, snippet, content>>."""
    blocks = F.slice(F.split(c, r"\n(?=Title:\s)"), 1, limit)
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            T.strip(F.regexp_extract(b, r"(?m)^URL Source:\s*(.+)$", 1)).alias("url"),
            T.strip(F.regexp_extract(b, r"(?m)^Title:\s*(.+)$", 1)).alias("title"),
            T.strip(F.regexp_extract(b, r"(?s)Markdown Content:\s*\n(.*)", 1)).alias("content"),
        ),
    )
    kept = F.filter(parsed, lambda p: (F.length(p["url"]) > 0) & (F.length(p["title"]) > 0))
    return F.transform(
        kept,
        lambda p: F.struct(p["url"], p["title"], F.left(p["content"], F.lit(200)).alias("snippet"), p["content"]),
    )


def top_rows(df: DataFrame, within: list[str], order: list[Column], k: int, name: str = "r") -> DataFrame:
    """First ``k`` rows per group; the rank filter is pushed below the shuffle as a group limit."""
    w = W.partitionBy(*within).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
