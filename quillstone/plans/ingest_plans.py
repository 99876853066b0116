"""Queries over sources, URLs, pages, responses and registry tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K, text as T
from ..operators import atoms as A, publish as P, registry_tables as R, responses as J, sections as H, trees, urls as U
from ..session import shared_dir
from ..sources import files
from . import sqlparts as S
from .registry import query, table

# --- scans and sinks -----------------------------------------------------------------------------


@query("transcript_scan", "S1", f"""
SELECT 'doc_' || doc_id || '.txt' AS filename, {S.words('text')} AS word_count, length(text) AS n_chars FROM documents WHERE length(text) > 0""")
def transcript_scan(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("text", "content")
    return files.non_empty(d).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        T.word_count(F.col("content")).cast("long").alias("word_count"), F.length("content").alias("n_chars"))


@query("artifact_round_trip", "S2 S3", """
SELECT source AS build_id, CAST(doc_id AS VARCHAR) AS id, text AS content, lang AS category,
 CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'flagged' END AS status FROM documents""")
def artifact_round_trip(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("build_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
        F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("flagged").alias("status"),
        F.lit("dropped on typed load").alias("unknown_field"))
    path = f"{shared_dir(spark)}/quillstone/artifact-{abs(hash(sf))}"
    files.write_phase(d, path, fmt="json")
    schema = "build_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.ATOM)
    back = spark.read.schema(schema).json(path)
    return back.select("build_id", "id", "content", "category", "status")


@query("artifact_counters", "S3", """
SELECT source AS build_id, count(*) AS total_atoms, count(*) FILTER (doc_id % 3 = 0) AS verified, count(*) FILTER (doc_id % 3 = 1) AS flagged FROM documents GROUP BY source""")
def artifact_counters(spark, sf):
    status = F.when(F.col("doc_id") % 3 == 0, "verified").when(F.col("doc_id") % 3 == 1, "flagged").otherwise("raw")
    d = table(spark, sf, "documents").select(F.col("source").alias("build_id"), status.alias("status"))
    return files.phase_counters(d)


@query("baseline_load", "S4", """
SELECT row_number() OVER (ORDER BY 'ref_' || item_id || '.md') - 1 AS ref_idx, 'ref_' || item_id || '.md' AS filename, length(text) // 4 AS tokens FROM benchmark""")
def baseline_load(spark, sf):
    b = table(spark, sf, "benchmark").select(
        F.concat(F.lit("ref_"), F.col("item_id").cast("string"), F.lit(".md")).alias("filename"),
        T.estimate_tokens(F.col("text")).alias("tokens"))
    return files.number_references(b, "filename")


@query("baseline_admission", "S5", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'skill_seekers' WHEN 1 THEN 'auto-discovery' WHEN 2 THEN 'auto-discovery-content' ELSE source END AS source
FROM documents WHERE doc_id % 4 < 3 AND doc_id % 5 > 0""")
def baseline_admission(spark, sf):
    i = F.col("doc_id")
    src = F.when(i % 4 == 0, K.BASELINE_SOURCES[0]).when(i % 4 == 1, K.BASELINE_SOURCES[1]).when(i % 4 == 2, K.BASELINE_SOURCES[2])
    d = table(spark, sf, "documents").select(
        "doc_id", F.coalesce(src, F.col("source")).alias("source"), F.slice(F.split("text", " "), 1, (i % 5).cast("int")).alias("references"))
    return files.admitted(d, need_references=True).select("doc_id", "source")


def _entries(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        F.concat(F.lit("bl_"), T.content_key(F.concat(U.host(F.col("url")), H.page_title(F.col("html"))), length=10)).alias("id"),
        H.page_title(F.col("html")).alias("title"), U.host(F.col("url")).alias("source_url"),
        T.content_key(F.col("html")).alias("content_hash"), F.col("page_id").alias("load_order"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600).alias("last_scraped"))


_TITLE_SQL = ("coalesce(nullif(" + S.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", ''), nullif("
              + S.strip("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')") + ", ''), 'Untitled')")
_HOST_SQL = f"lower(regexp_extract(url, '{U.HOST}', 1))"
_ENTRIES = f"""e AS (SELECT 'bl_' || left(sha256({_HOST_SQL} || {_TITLE_SQL}), 10) AS id, {_TITLE_SQL} AS title, {_HOST_SQL} AS source_url,
 left(sha256(html), 16) AS content_hash, page_id AS load_order, 1704067200 + page_id * 3600 AS scraped FROM pages)"""


@query("entry_upsert", "S6", f"""WITH {_ENTRIES}
SELECT id, title, source_url, content_hash, load_order FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load_order DESC) AS r FROM e) WHERE r = 1""")
def entry_upsert(spark, sf):
    e = _entries(spark, sf).drop("last_scraped")
    old, new = e.filter(F.col("load_order") % 2 == 0), e.filter(F.col("load_order") % 2 == 1)
    return R.upsert(old, new, "id", "load_order").select("id", "title", "source_url", "content_hash", "load_order")


@query("scrape_status", "S6", f"""WITH {_ENTRIES}
SELECT source_url, max(scraped) AS last_scraped, count(*) AS entry_count, arg_min(content_hash, load_order) AS content_hash FROM e GROUP BY source_url""")
def scrape_status(spark, sf):
    return R.scrape_status(_entries(spark, sf), "source_url", "load_order").withColumn(
        "last_scraped", F.unix_timestamp("last_scraped"))


@query("freshness", "S7", """
WITH s AS (SELECT user_id, max(ts) AS last_scraped FROM events WHERE event_type = 'view' AND value > 40 GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, coalesce(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_scraped)) < 168 * 3600, false) AS is_fresh FROM u LEFT JOIN s USING (user_id)""")
def freshness(spark, sf):
    e = table(spark, sf, "events")
    status = e.filter((F.col("event_type") == "view") & (F.col("value") > 40)).groupBy("user_id").agg(F.max("ts").alias("last_scraped"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return R.fresh(e.select("user_id").distinct(), status, "user_id", now).select("user_id", "is_fresh")


# --- source trees --------------------------------------------------------------------------------

_NAMES = ["README.md", "src/main.py", "docs/guide.md", "tests/run_test.py", "package.json", "node_modules/x.js", "lib/util.go",
          "yarn.lock", "docs/README.rst", "app/server.ts", "notes.txt", "core/deep/er/file.rs"]


def _tree(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    folder = F.regexp_replace(F.regexp_extract("url", U.HOST, 1), r"\..*", "")
    return table(spark, sf, "pages").select(
        (F.col("page_id") % 5).alias("repo"), F.concat(folder, F.lit("/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), name).alias("path"),
        (F.length("html") * 3).alias("size"))


def _ends(x, values):
    return "(" + " OR ".join(f"suffix({x}, {S.q(v)})" for v in values) + ")"


_LANG_SQL = "CASE " + " ".join(f"WHEN sfx = {S.q(k)} THEN {S.q(v)}" for k, v in K.LANGUAGES.items()) + " END"
_TREE = f"""
f AS (SELECT page_id % 5 AS repo, regexp_replace(regexp_extract(url, '{U.HOST}', 1), '\\..*', '') || '/' || (page_id % 7) || '/' ||
  ([{', '.join(S.q(n) for n in _NAMES)}])[(page_id % {len(_NAMES)}) + 1] AS path, length(html) * 3 AS size FROM pages),
g AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1) AS sfx,
  regexp_replace(path, '/?[^/]*$', '') AS parent FROM f WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(S.q(d) for d in K.IGNORED_DIRS)}])),
t AS (SELECT *, CASE WHEN starts_with(lower(name), 'readme') THEN 'readme' WHEN name IN {S.in_list(K.CONFIG_FILES)} THEN 'config'
  WHEN contains(lower(parent), 'doc') AND sfx IN {S.in_list(K.DOC_SUFFIXES)} THEN 'doc' WHEN contains(lower(path), 'test') AND sfx IN {S.in_list(K.LANGUAGES)} THEN 'test'
  WHEN sfx IN {S.in_list(K.LANGUAGES)} THEN 'source' ELSE 'other' END AS k0 FROM g WHERE name NOT IN {S.in_list(K.IGNORED_FILES)}),
c AS (SELECT repo, path, size, sfx, CASE WHEN k0 = 'readme' AND path <> min(CASE WHEN k0 = 'readme' THEN path END) OVER (PARTITION BY repo) THEN 'other' ELSE k0 END AS kind,
  CASE WHEN k0 = 'source' THEN {_LANG_SQL} END AS language FROM t)"""


@query("tree_classification", "S8", f"WITH {_TREE} SELECT repo, path, size, kind, language FROM c")
def tree_classification(spark, sf):
    return trees.classify(_tree(spark, sf), "repo", "path")


_SCORE_SQL = (f"CASE WHEN {_ends('path', K.ENTRY_POINTS)} THEN 100 ELSE 0 END + greatest(0, 10 - (length(path) - length(replace(path, '/', '')))) * 5 "
              "+ least(size // 1000, 20)")


@query("source_ranking", "W2", f"""WITH {_TREE}, s AS (SELECT repo, path, {_SCORE_SQL} AS score FROM c WHERE kind = 'source')
SELECT repo, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 20""")
def source_ranking(spark, sf):
    c = trees.classify(_tree(spark, sf), "repo", "path")
    return trees.top_sources(c, "repo", "path", "size").select("repo", "path", "score", "rank")


@query("repository_profile", "A20", f"""WITH {_TREE},
l AS (SELECT repo, language, count(*) AS n, min(path) AS f FROM c WHERE language IS NOT NULL GROUP BY 1, 2),
m AS (SELECT repo, string_agg(language || '=' || n, ',' ORDER BY language) AS languages, arg_min(language, ROW(-n, f)) AS primary_language FROM l GROUP BY repo),
g2 AS (SELECT repo, string_agg(path, ',' ORDER BY path) AS config_files FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM c WHERE kind = 'config') WHERE r <= 5 GROUP BY repo)
SELECT c.repo, count(*) AS total_files, bool_or(kind = 'test') AS has_tests, bool_or(kind = 'doc') AS has_docs, coalesce(any_value(m.primary_language), 'unknown') AS primary_language,
  coalesce(any_value(m.languages), '') AS languages, coalesce(any_value(config_files), '') AS config_files FROM c LEFT JOIN m USING (repo) LEFT JOIN g2 USING (repo) GROUP BY c.repo""")
def repository_profile(spark, sf):
    p = trees.profile(trees.classify(_tree(spark, sf), "repo", "path"), "repo", "path")
    pairs = F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.withColumn("languages", F.coalesce(F.array_join(pairs, ","), F.lit(""))).withColumn(
        "config_files", F.coalesce(F.array_join("config_files", ","), F.lit("")))


@query("front_matter_samples", "S9", f"""
WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || {S.NL} || 'name: x' || {S.NL} || '---' || {S.NL} || text ELSE text END AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM d),
s AS (SELECT source, doc_id, CASE WHEN starts_with(t, '---') AND instr(substring(t, 4), '---') > 0 THEN {S.strip("substring(t, instr(substring(t, 4), '---') + 6)")} ELSE t END AS t FROM r WHERE r <= 5),
c AS (SELECT source, doc_id, CASE WHEN length(t) > 3000 THEN left(t, 3000) || {S.NL} || '...[truncated]' ELSE t END AS t FROM s)
SELECT source, doc_id, {S.strip('t')} AS content FROM c WHERE length({S.strip('t')}) > 50""")
def front_matter_samples(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nname: x\n---\n"), "text")).otherwise(F.col("text")).alias("t"))
    body = H.strip_front_matter(F.col("t"))
    cut = H.limit_content(body, 3000, "\n...[truncated]")
    picked = U.top_rows(d, ["source"], [F.col("doc_id")], 5).select("source", "doc_id", T.strip(cut).alias("content"))
    return picked.filter(F.length("content") > 50)


@query("chapter_merge", "S10", f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'intro.pdf' ELSE format('{{:02d}}', turn) || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '_' END || role || '.pdf' END AS name, text FROM conversations),
m AS (SELECT conv_id, CAST(regexp_extract(name, '(?i)^(\\d{{1,3}})[\\s._-]+(.+)\\.pdf$', 1) AS INT) AS n, name, {S.strip('text')} AS text FROM c WHERE regexp_matches(name, '(?i)^(\\d{{1,3}})[\\s._-]+(.+)\\.pdf$')),
k AS (SELECT conv_id, count(*) AS n FROM m GROUP BY conv_id HAVING count(*) >= 2)
SELECT conv_id, 0 AS part, any_value(k.n) AS chapters, {S.strip(f"string_agg({S.NL} || '--- ' || name || ' ---' || {S.NL} || {S.NL} || text, {S.NL} || {S.NL} ORDER BY m.n) FILTER (length(text) > 0)")} AS merged
FROM m JOIN k USING (conv_id) GROUP BY conv_id""")
def chapter_merge(spark, sf):
    c = table(spark, sf, "conversations")
    name = F.when(F.col("role") == "system", "intro.pdf").otherwise(F.concat(
        F.format_string("%02d", "turn"), F.when(F.col("turn") % 2 == 0, " ").otherwise("_"), "role", F.lit(".pdf")))
    return P.merge_chapters(c.select("conv_id", name.alias("name"), "text"), "conv_id", "name", "text")


@query("scraped_pages", "S11", f"""
WITH p AS (SELECT url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS links, regexp_extract_all(html, '<h([1-6])[^>]*>', 1) AS hs FROM pages)
SELECT url, CAST(len(links) AS INT) AS n_links, coalesce(links[1], '') AS first_link, CAST(len(hs) AS INT) AS n_headings, coalesce(hs[1], '') AS first_level FROM p""")
def scraped_pages(spark, sf):
    """Pages written in the scraper's nested form and read back by the page reader."""
    p = table(spark, sf, "pages").select(
        "url", H.page_title(F.col("html")).alias("title"), F.lit("").alias("content"),
        F.transform(F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), 1), lambda h: F.struct(h.alias("level"), F.lit("").alias("text"), F.lit("").alias("id"))).alias("headings"),
        F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), 1).alias("links"))
    path = f"{shared_dir(spark)}/quillstone/scraped-{uuid.uuid4().hex}"
    files.write_scraped_pages(p, path)
    return files.read_scraped_pages(spark, path, lines=True).select(
        "url", F.size("links").alias("n_links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"),
        F.size("headings").alias("n_headings"), F.coalesce(F.get("headings", F.lit(0))["level"], F.lit("")).alias("first_level"))


@query("registry_patch", "S12", """
WITH c AS (SELECT user_id AS o_orderkey, event_id, CASE WHEN event_type = 'view' THEN substring('OFP', CAST(event_id % 3 AS INT) + 1, 1) END AS st,
  CASE WHEN event_type = 'click' THEN value END AS pr FROM events),
p AS (SELECT o_orderkey, arg_max(st, event_id) FILTER (st IS NOT NULL) AS st, arg_max(pr, event_id) FILTER (pr IS NOT NULL) AS pr FROM c GROUP BY o_orderkey),
x AS (SELECT DISTINCT user_id AS o_orderkey FROM events WHERE event_type = 'error' AND value > 250)
SELECT o.o_orderkey, coalesce(p.st, o_orderstatus) AS o_orderstatus, coalesce(p.pr, o_totalprice) AS o_totalprice FROM orders o LEFT JOIN p USING (o_orderkey)
WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM x)""")
def registry_patch(spark, sf):
    e = table(spark, sf, "events")
    letter = F.element_at(F.array(F.lit("O"), F.lit("F"), F.lit("P")), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_type") == "view", letter)
    changes = e.select(F.col("user_id").alias("o_orderkey"), "event_id", status.alias("o_orderstatus"),
                       F.when(F.col("event_type") == "click", F.col("value")).alias("o_totalprice"))
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    gone = e.filter((F.col("event_type") == "error") & (F.col("value") > 250)).select(F.col("user_id").alias("o_orderkey"))
    return R.delete(R.patch(base, changes, "o_orderkey", "event_id", ["o_orderstatus", "o_totalprice"]), gone, "o_orderkey")


@query("registry_usage", "S12", """
SELECT c_custkey, c_nationkey + coalesce(n, 0) AS usage_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def registry_usage(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("usage_count"))
    return R.add_usage(base, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "usage_count")


@query("settings_replace", "S12", """
SELECT event_type || '_' || (user_id % 10) AS key, arg_max(value, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1""")
def settings_replace(spark, sf):
    s = table(spark, sf, "events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("key"), "value", F.col("event_id").alias("updated_at"))
    half = s.filter(F.col("updated_at") % 2 == 0)
    return R.upsert(half, s.filter(F.col("updated_at") % 2 == 1), "key", "updated_at")


@query("entry_reads", "S13", f"""
SELECT {_HOST_SQL} AS source_url, count(*) AS n, max(len(string_split(trim(regexp_extract(url, '{U.PATH}', 1), '/'), '/'))) AS longest FROM pages GROUP BY 1""")
def entry_reads(spark, sf):
    stored = F.to_json(F.split(F.btrim(U.path(F.col("url")), F.lit("/")), "/"))
    e = table(spark, sf, "pages").select(U.host(F.col("url")).alias("source_url"), stored.alias("keywords"))
    decoded = e.withColumn("keywords", F.from_json("keywords", "array<string>"))
    return decoded.groupBy("source_url").agg(F.count("*").alias("n"), F.max(F.size("keywords")).alias("longest"))


@query("entries_by_source", "S13", f"""
WITH e AS (SELECT page_id, {_HOST_SQL} AS source_url, url FROM pages), s AS (SELECT DISTINCT source_url FROM e WHERE page_id % 3 = 0)
SELECT page_id, source_url, url FROM e JOIN s USING (source_url)""")
def entries_by_source(spark, sf):
    e = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("source_url"), "url")
    asked = e.filter(F.col("page_id") % 3 == 0).select("source_url")
    return R.entries_of(e, asked, "source_url")


# --- URLs ----------------------------------------------------------------------------------------


@query("url_list", "C15", """
WITH l AS (SELECT page_id, url || ', ftp://x.org/a' || chr(10) || ' ' || replace(url, 'http', 'https') || ',http:///nohost,,' AS s FROM pages),
u AS (SELECT page_id, unnest(string_split_regex(s, '[,\\n]+')) AS u FROM l)
SELECT page_id, """ + S.strip("u") + """ AS url FROM u WHERE regexp_matches(""" + S.strip("u") + """, '^https?://[^/?#]+')""")
def url_list(spark, sf):
    s = F.concat("url", F.lit(", ftp://x.org/a\n "), F.replace("url", F.lit("http"), F.lit("https")), F.lit(",http:///nohost,,"))
    return table(spark, sf, "pages").select("page_id", F.explode(U.parse_list(s)).alias("url"))


_NORM_SQL = (f"lower(regexp_extract(url, '{U.SCHEME}', 1) || '://' || regexp_extract(url, '{U.HOST}', 1) || rtrim(regexp_extract(url, '{U.PATH}', 1), '/'))")


@query("url_properties", "C16 C18 C19", f"""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '.example', '.github.com.example') WHEN 1 THEN url || '/business/help' ELSE url END AS url FROM pages)
SELECT page_id, {_NORM_SQL} AS normalised, CASE WHEN contains(url, 'github.com') THEN 'github' WHEN contains(url, 'developers.facebook.com') THEN 'api_docs'
 WHEN contains(url, 'business/help') THEN 'help_center' ELSE 'html' END AS source_type,
 coalesce(nullif(left(regexp_replace(replace(trim(regexp_extract(url, '{U.PATH}', 1), '/'), '/', '-'), '[^a-zA-Z0-9-]', '', 'g'), 80), ''), 'page') AS file_name FROM p""")
def url_properties(spark, sf):
    i = F.col("page_id")
    u = F.when(i % 6 == 0, F.replace("url", F.lit(".example"), F.lit(".github.com.example"))).when(
        i % 6 == 1, F.concat("url", F.lit("/business/help"))).otherwise(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", u.alias("url"))
    c = F.col("url")
    return p.select("page_id", U.normalise(c).alias("normalised"), U.source_type(c).alias("source_type"), U.safe_name(c).alias("file_name"))


_TAILS = ["/Login", "/docs/a.pdf", "/search?q=x", "/guide", "#comment-1", "/tag/x", "/privacy", "/feed/"]


@query("url_exclusion", "C17", f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 8 THEN 'https://Figma.com/x' ELSE url || ([{', '.join(S.q(t) for t in _TAILS)}])[(page_id % 8) + 1] END AS url FROM pages)
SELECT page_id, {_HOST_SQL} IN {S.in_list(K.SCRIPTED_HOSTS)} AS scripted, {S.any_of('lower(url)', K.EXCLUDE_DISCOVERY)} AS not_discovered,
 {S.any_of('lower(url)', K.EXCLUDE_EVALUATION)} AS not_evaluated, {S.any_of('lower(url)', K.EXCLUDE_CONTENT)} AS not_fetched, {S.any_of('url', ('/en/', 'blog'))} AS matches FROM p""")
def url_exclusion(spark, sf):
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("page_id") % 8 + 1).cast("int"))
    u = F.when(F.col("page_id") % 9 == 8, "https://Figma.com/x").otherwise(F.concat("url", tail))
    p = table(spark, sf, "pages").select("page_id", u.alias("url"))
    c = F.col("url")
    return p.select("page_id", U.is_scripted(c).alias("scripted"), U.excluded(c, K.EXCLUDE_DISCOVERY).alias("not_discovered"),
                    U.excluded(c, K.EXCLUDE_EVALUATION).alias("not_evaluated"), U.excluded(c, K.EXCLUDE_CONTENT).alias("not_fetched"),
                    U.matches(c, ("/en/", "blog")).alias("matches"))


_SEGMENTS = {"AUTOMOBILE": "facebook-ads", "BUILDING": "googleads", "FURNITURE": "fb_ads", "MACHINERY": "custom"}


@query("taxonomy_lookup", "C20", f"""
WITH t(tax, cat, ord, subs) AS (VALUES {', '.join(f"({S.q(n)}, {S.q(c)}, {i}, {len(s.split())})" for n, cs in K.TAXONOMY.items() for i, (c, s) in enumerate(cs.items()))}),
c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'fb_ads' WHEN 'BUILDING' THEN 'google_ads' WHEN 'FURNITURE' THEN 'fb_ads' ELSE 'custom' END AS tax FROM customer)
SELECT c_custkey, tax AS taxonomy, string_agg(cat, ',' ORDER BY ord) AS categories, CAST(sum(subs) AS BIGINT) AS n_subcategories FROM c JOIN t USING (tax) GROUP BY 1, 2""")
def taxonomy_lookup(spark, sf):
    domain = F.create_map(*[F.lit(x) for kv in _SEGMENTS.items() for x in kv])[F.col("c_mktsegment")]
    c = table(spark, sf, "customer").select("c_custkey", A.taxonomy_name(F.coalesce(domain, F.col("c_mktsegment"))).alias("taxonomy"))
    dim = A.taxonomy(spark).groupBy("taxonomy").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "category"))), lambda x: x["category"]), ",").alias("categories"),
        F.sum(F.size("subcategories")).alias("n_subcategories"))
    return c.join(dim, "taxonomy")


@query("category_fallback", "C21", """
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE source END AS c, CASE doc_id % 7 WHEN 0 THEN ' Custom' WHEN 1 THEN lang ELSE source || 'x' END AS dom FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(c, '')) = '' THEN 'general' ELSE c END AS category, trim(lower(dom)) IN ('custom', 'unknown', 'general', 'other', 'misc', 'test', 'default') OR length(trim(dom)) <= 3 AS generic FROM d""")
def category_fallback(spark, sf):
    i = F.col("doc_id")
    c = F.when(i % 5 == 0, " ").when(i % 5 == 1, F.lit(None)).otherwise(F.col("source"))
    dom = F.when(i % 7 == 0, " Custom").when(i % 7 == 1, F.col("lang")).otherwise(F.concat("source", F.lit("x")))
    return table(spark, sf, "documents").select("doc_id", A.category_or_general(c).alias("category"), A.is_generic_domain(dom).alias("generic"))


# --- pages ---------------------------------------------------------------------------------------


@query("html_sections", "H1 F2")
def html_sections(spark, sf):
    h = H.html_sections(table(spark, sf, "pages"), "page_id", "url", "html")
    return h.select("page_id", "section", "title", "content", F.array_join("section_path", " > ").alias("section_path"),
                    "entry_id", F.array_join("keywords", " ").alias("keywords"), "content_hash")


def _md():
    return F.array_join(F.transform(T.lines(F.col("text")), lambda x, i: F.when(i % 3 == 1, F.concat(
    F.element_at(F.array(F.lit("# "), F.lit("## "), F.lit("### "), F.lit("#### ")), (i % 4 + 1).cast("int")), F.left(x, F.lit(30)))).otherwise(x)), "\n")

_MD_SQL = f"array_to_string(list_transform(string_split(text, {S.NL}), lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN (['# ', '## ', '### ', '#### '])[(i - 1) % 4 + 1] || left(x, 30) ELSE x END), {S.NL})"


@query("markdown_sections", "H2", f"""
WITH m AS (SELECT doc_id, source, string_split({_MD_SQL}, {S.NL}) AS l FROM documents),
x AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM m),
y AS (SELECT *, regexp_matches(line, '^#{{1,3}}[^\\S\\n]+.') AS h FROM x),
z AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM y),
g AS (SELECT doc_id, source, s, coalesce(max(CASE WHEN h THEN {S.strip("regexp_extract(line, '^#{1,3}[^\\S\\n]+(.+)', 1)")} END), 'Introduction') AS title,
  {S.strip(f"coalesce(string_agg(CASE WHEN NOT h THEN line END, {S.NL} ORDER BY i), '')")} AS content FROM z GROUP BY doc_id, source, s)
SELECT doc_id, title, content, 'bl_' || left(sha256(source || title), 10) AS entry_id, left(sha256(content), 16) AS content_hash FROM g WHERE length(content) >= 50""")
def markdown_sections(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", _md().alias("text"))
    return H.markdown_sections(d, "source", "text").select("doc_id", "title", "content", "entry_id", "content_hash")


@query("titles", "H3", f"""
WITH m AS (SELECT doc_id, source, list_transform(string_split(CASE WHEN doc_id % 4 = 0 THEN '---' || {S.NL} || '#ab' || {S.NL} ELSE '' END || {_MD_SQL}, {S.NL}), lambda x: {S.strip('x')}) AS l FROM documents),
a AS (SELECT doc_id, source, list_filter(l, lambda s: starts_with(s, '# ') OR (length(s) > 5 AND s <> '---'))[1] AS mt,
  list_filter(l, lambda s: (starts_with(s, '#') AND length({S.strip("ltrim(s, '#')")}) > 3) OR (length(s) > 5 AND NOT starts_with(s, '---')))[1] AS rt FROM m)
SELECT doc_id, coalesce(CASE WHEN starts_with(mt, '# ') THEN {S.strip('substring(mt, 3)')} ELSE mt END, 'Untitled') AS markdown_title,
  coalesce(left(CASE WHEN starts_with(rt, '#') AND length({S.strip("ltrim(rt, '#')")}) > 3 THEN {S.strip("ltrim(rt, '#')")} ELSE rt END, 120), 'Guide ' || upper(left(source, 1)) || substring(source, 2)) AS reference_title FROM a""")
def titles(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, "---\n#ab\n").otherwise("")
    d = table(spark, sf, "documents").select("doc_id", "source", F.concat(head, _md()).alias("t"))
    url = F.concat(F.lit("https://x.org/a/guide_"), "source", F.lit("/"))
    return d.select("doc_id", H.markdown_title(F.col("t")).alias("markdown_title"), H.reference_title(F.col("t"), url).alias("reference_title"))


_TEXT_SQL = S.strip("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<header[^>]*>.*?</header>', '', 'g'), '<[^>]+>', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query("page_text", "H4 H3", f"""
SELECT page_id, {_TITLE_SQL} AS title, left({_TEXT_SQL}, 50000) AS content, length({_TEXT_SQL}) >= 200 AS usable FROM pages""")
def page_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title"), H.html_text(F.col("html")).alias("t"))
    return p.select("page_id", "title", F.left("t", F.lit(H.MAX_CONTENT)).alias("content"), (F.length("t") >= 200).alias("usable"))


@query("html_to_markdown", "H5 F2")
def html_to_markdown(spark, sf):
    return H.html_to_markdown(table(spark, sf, "pages"), "page_id", "html")


_OWN_LINKS = r"""'<a[^>]*href="([^"]*)"[^>]*>'"""
_FOLDER = f"CASE WHEN regexp_extract(url, '{U.PATH}', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '{U.PATH}', 1), '[^/]*$', '') END"
# Links added to every page, and where each leads; NULL: not a link inside the site.
_MORE_LINKS = (
    ("rel/x", "base || folder || 'rel/x'"), ("#top", "NULL"), ("mailto:a@b", "NULL"), ("", "url"), ("../x", "base || parent || 'x'"),
    ("./y/", "base || folder || 'y/'"), ("/p/./q/../r?s=/../t#u", "base || '/p/r?s=/../t#u'"), ("?q=1", "base || path || '?q=1'"),
    ("..", "base || parent"), ("/..", "base || '/'"), ("a//b", "base || folder || 'a/b'"), ("javascript:void(0)", "NULL"), ("tel:123", "NULL"),
    ("ftp://elsewhere.example/x", "NULL"), ("//elsewhere.example/x", "NULL"),
)


@query("link_table", "H6", f"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '{U.SCHEME}', 1) || '://' || regexp_extract(url, '{U.HOST}', 1) AS base, regexp_extract(url, '{U.PATH}', 1) AS path,
  {_FOLDER} AS folder, CASE WHEN {_FOLDER} = '/' THEN '/' ELSE regexp_replace({_FOLDER}, '[^/]+/$', '') END AS parent, regexp_extract_all(html, {_OWN_LINKS}, 1) AS own FROM pages),
a AS (SELECT page_id, base || h AS link, i FROM (SELECT page_id, base, unnest(own) AS h, generate_subscripts(own, 1) AS i FROM p) WHERE starts_with(h, '/')),
b AS ({" UNION ALL ".join(f"SELECT page_id, {leads} AS link, 1000 + {i} AS i FROM p" for i, (_, leads) in enumerate(_MORE_LINKS))}
  UNION ALL SELECT page_id, url, 2000 FROM p),
s AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE link IS NOT NULL)
SELECT page_id, link, pos FROM s WHERE pos < 30""")
def link_table(spark, sf):
    more = "".join(f'<a href="{h}">' for h, _ in _MORE_LINKS)
    html = F.concat("html", F.lit(more), F.lit('<a\nhref="'), "url", F.lit('">'))
    p = table(spark, sf, "pages").select("page_id", "url", html.alias("html"))
    return U.page_links(p, "url", "html").select("page_id", "link", "pos")


_SITEMAP = """'<sitemapindex><sitemap> <loc>map:' || (page_id + 1) || '</loc></sitemap><sitemap><loc>map:none</loc></sitemap></sitemapindex>
<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><lastmod>x</lastmod><loc>' || replace(url, '&', '&amp;') || '/docs</loc></url></urlset>'"""


@query("sitemap_links", "H6 X2", """
WITH r AS (SELECT a.page_id, 0 AS level, b.url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 UNION ALL SELECT page_id, 1, url FROM pages),
l AS (SELECT page_id, level, 0 AS i, url AS link FROM r UNION ALL SELECT page_id, level, 1, url || '/docs' FROM r)
SELECT 'map:' || page_id AS root, row_number() OVER (PARTITION BY page_id ORDER BY level, i) - 1 AS pos, link FROM l""")
def sitemap_links(spark, sf):
    maps = table(spark, sf, "pages").select(F.concat(F.lit("map:"), "page_id").alias("url"), F.expr(_SITEMAP).alias("xml"))
    return U.sitemap_links(maps, maps.select("url"), "url", "xml")


@query("heading_topics", "H7", f"""
WITH l AS (SELECT source, doc_id, unnest(string_split({_MD_SQL}, {S.NL})) AS x, generate_subscripts(string_split({_MD_SQL}, {S.NL}), 1) AS i FROM documents),
f AS (SELECT source, 1 AS part, doc_id AS ord, i, {S.strip("regexp_replace(" + S.strip('x') + ", '^#+\\s*', '')")} AS topic FROM l WHERE starts_with({S.strip('x')}, '## ') OR starts_with({S.strip('x')}, '### ')),
g AS (SELECT source, 0, min(doc_id), 0, lang FROM documents GROUP BY source, lang),
u AS (SELECT * FROM f UNION ALL SELECT * FROM g)
SELECT source, topic, part AS first_part FROM (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY part, ord, i) AS r FROM u WHERE topic <> '') WHERE r = 1""")
def heading_topics(spark, sf):
    d = table(spark, sf, "documents")
    given = d.groupBy("source", F.col("lang").alias("topic")).agg(F.min("doc_id").alias("ord"))
    t = H.heading_topics(d.select("source", "doc_id", _md().alias("md")), "source", "doc_id", "md", given)
    return t.select("source", "topic", F.col("at.part").alias("first_part"))


# --- model answers -------------------------------------------------------------------------------

@query("response_ingest", "H8 F3", """
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'extracted' WHEN 2 THEN 'repaired' ELSE 'quarantined' END AS parse_status,
 CASE (conv_id + turn) % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS n_topics, CASE WHEN (conv_id + turn) % 4 < 3 THEN role || ' ' || turn END AS first_topic FROM conversations WHERE role = 'assistant'""")
def response_ingest(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    name = F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"topics": [{"topic": "'), name, F.lit('", "mentions": 2}]}\n```')))
        .when(kind == 1, F.concat(F.lit('Here it is: {"topics": [{"topic": "'), name, F.lit('"}]} as asked')))
        .when(kind == 2, F.concat(F.lit('{"topics": [{"topic": "'), name, F.lit('"}, {"topic": "cut of')))
        .otherwise(F.col("text")))
    d = J.ingest(c.select("conv_id", "turn", answer.alias("answer")), "answer", "topics array<struct<topic: string, mentions: int>>")
    return d.select("conv_id", "turn", "parse_status", F.when(F.col("parsed").isNotNull(), F.nullif(F.size("parsed.topics"), F.lit(-1))).alias("n_topics"),
                    F.get("parsed.topics", F.lit(0))["topic"].alias("first_topic"))


@query("atom_typing", "H9", f"""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN left(text, 40) END AS title, text AS content, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE ' ' END AS category,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS tags, CASE WHEN doc_id % 2 = 0 THEN 0.75::DOUBLE END AS confidence, CASE WHEN doc_id % 6 = 0 THEN lang END AS snippet, CASE WHEN doc_id % 7 = 0 THEN 'function' END AS ptype FROM documents)
SELECT doc_id, s AS stream, coalesce(title, 'Untitled') AS title, CASE WHEN s = 'code' THEN 'code_pattern' WHEN category = ' ' THEN 'general' ELSE category END AS category,
  coalesce(confidence, CASE WHEN s = 'transcript' THEN 0.5 ELSE 0.85 END::DOUBLE) AS confidence,
  concat_ws(',', tags, CASE WHEN s = 'code' THEN 'code' END, CASE WHEN s = 'code' THEN coalesce(ptype, 'general') END) AS tags,
  length(content) + CASE WHEN s = 'code' AND snippet IS NOT NULL THEN length(snippet) + 10 ELSE 0 END AS content_length,
  CASE s WHEN 'transcript' THEN 'transcript' WHEN 'gap' THEN 'baseline' ELSE 'codebase' END AS source, s = 'gap' AS gap_filled
FROM b CROSS JOIN (VALUES ('transcript'), ('gap'), ('code')) v(s)""")
def atom_typing(spark, sf):
    i = F.col("doc_id")
    raw = table(spark, sf, "documents").select(
        "doc_id", F.when(i % 3 != 0, F.left("text", F.lit(40))).alias("title"), F.col("text").alias("content"),
        F.when(i % 4 != 0, F.col("lang")).otherwise(" ").alias("category"), F.when(i % 5 != 0, F.array("source")).alias("tags"),
        F.when(i % 2 == 0, F.lit(0.75)).alias("confidence"), F.when(i % 6 == 0, F.col("lang")).alias("code_snippet"), F.when(i % 7 == 0, F.lit("function")).alias("pattern_type"))
    u = A.union_streams(A.typed(raw, "transcript"), A.typed(raw, "gap"), A.typed(raw, "code"))
    return u.select("doc_id", F.element_at(F.array(F.lit("transcript"), F.lit("gap"), F.lit("code")), F.col("stream") + 1).alias("stream"), "title", "category",
                    "confidence", F.array_join("tags", ",").alias("tags"), F.length("content").alias("content_length"), "source", "gap_filled")


@query("front_matter_fields", "H10", f"""
WITH d AS (SELECT doc_id, '---' || {S.NL} || 'name: ' || source || {S.NL} || CASE WHEN doc_id % 2 = 0 THEN 'description: >' || {S.NL} || '  part of ' || lang || {S.NL} || '  and more' ELSE 'description: ' || lang || ' text' END
  || {S.NL} || 'source_url: https://x.org/' || doc_id || {S.NL} || '---' || {S.NL} || text AS t FROM documents)
SELECT doc_id, regexp_extract(t, 'name: ([^\\n]*)', 1) AS name, CASE WHEN doc_id % 2 = 0 THEN 'part of ' || substring(regexp_extract(t, 'part of ([^\\n]*)', 1), 1) || ' and more' ELSE regexp_extract(t, 'description: ([^\\n]*)', 1) END AS description,
  'https://x.org/' || doc_id AS source_url FROM d""")
def front_matter_fields(spark, sf):
    desc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("description: >\n  part of "), "lang", F.lit("\n  and more"))).otherwise(
        F.concat(F.lit("description: "), "lang", F.lit(" text")))
    t = F.concat(F.lit("---\nname: "), "source", F.lit("\n"), desc, F.lit("\nsource_url: https://x.org/"), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", *[H.front_matter_field(F.col("t"), f).alias(f) for f in ("name", "description", "source_url")])


@query("search_result_blocks", "H11", f"""
WITH b AS (SELECT page_id, list_transform(range(7), lambda k: 'Title: T' || k || ' ' || {_HOST_SQL} || {S.NL} || 'URL Source: ' || url || '/' || k || {S.NL} || 'Markdown Content:' || {S.NL} || {_TEXT_SQL}) AS bs FROM pages)
SELECT page_id, k AS pos, 'T' || k || ' ' || {_HOST_SQL} AS title, url || '/' || k AS url, left({_TEXT_SQL}, 200) AS snippet, length({_TEXT_SQL}) AS content_length FROM pages CROSS JOIN range(5) r(k)""")
def search_result_blocks(spark, sf):
    body = H.html_text(F.col("html"))
    p = table(spark, sf, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"), body.alias("body"))
    block = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.concat(
        F.lit("Title: T"), k.cast("string"), F.lit(" "), "host", F.lit("\nURL Source: "), "url", F.lit("/"), k.cast("string"), F.lit("\nMarkdown Content:\n"), "body")), "\n")
    q = p.select("page_id", F.posexplode(U.search_blocks(block)).alias("pos", "b"))
    return q.select("page_id", "pos", "b.title", "b.url", "b.snippet", F.length("b.content").alias("content_length"))


@query("search_result_pages", "H11", f"""
WITH r AS (SELECT page_id, k, CASE k % 3 WHEN 0 THEN url WHEN 1 THEN substring(url, instr(url, '//')) ELSE 'https://found.org/?a=1&b=' || page_id END AS u FROM pages CROSS JOIN range(20) x(k))
SELECT page_id, k AS pos, CASE WHEN k % 3 = 1 THEN 'https:' || u ELSE u END AS url, 'Hit ' || k AS title, 'about ' || k AS snippet FROM r WHERE k < 15""")
def search_result_pages(spark, sf):
    href = lambda k: (F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.substr("url", F.instr("url", "//")))
                      .otherwise(F.concat(F.lit("/l/?uddg="), F.url_encode(F.concat(F.lit("https://found.org/?a=1&b="), F.col("page_id").cast("string"))), F.lit("&rut=1"))))
    html = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(
        F.lit('<div><a rel="n" class="result__a" href="'), href(k), F.lit('"><b>Hit</b> '), k.cast("string"),
        F.lit('</a><a class="result__snippet">about <i>'), k.cast("string"), F.lit("</i></a></div>"))), "\n")
    p = table(spark, sf, "pages").select("page_id", F.posexplode(U.search_results_html(html)).alias("pos", "r"))
    return p.select("page_id", "pos", "r.url", "r.title", "r.snippet")


# --- streams, unions, ids ------------------------------------------------------------------------


@query("stream_union", "X1", """
SELECT stream, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 0 AS stream, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages
 UNION ALL SELECT 2, conv_id * 100 + turn FROM conversations) GROUP BY stream""")
def stream_union(spark, sf):
    u = A.union_streams(
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"),
        table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id")))
    return u.groupBy("stream").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("candidate_union", "X2", f"""
WITH u AS (SELECT page_id * 3 AS ord, url FROM pages UNION ALL SELECT page_id * 3 + 10000000, url || '?again=1' FROM pages UNION ALL SELECT page_id * 3 + 1, upper(url) || '/' FROM pages WHERE page_id % 2 = 0),
n AS (SELECT ord, url, {_NORM_SQL} AS normalised FROM u)
SELECT normalised, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY normalised ORDER BY ord) AS r FROM n) WHERE r = 1 ORDER BY ord LIMIT 100""")
def candidate_union(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    again = p.select((F.col("page_id") * 3 + 10000000).alias("ord"), F.concat("url", F.lit("?again=1")).alias("url"))
    crawl = p.filter(F.col("page_id") % 2 == 0).select((F.col("page_id") * 3 + 1).alias("ord"), F.concat(F.upper("url"), F.lit("/")).alias("url"))
    return U.distinct_candidates(p.select((F.col("page_id") * 3).alias("ord"), "url").unionByName(again).unionByName(crawl), "url", "ord")


@query("scored_urls", "J23", """
SELECT page_id AS ord, url, round(CASE WHEN page_id % 5 = 0 THEN 5.0 ELSE (page_id % 11) * 0.4::DOUBLE + (page_id % 7) * 0.3::DOUBLE + (page_id % 3) * 0.3::DOUBLE END, 6) AS combined_score
FROM pages ORDER BY CASE WHEN page_id % 5 = 0 THEN 5.0 ELSE (page_id % 11) * 0.4::DOUBLE + (page_id % 7) * 0.3::DOUBLE + (page_id % 3) * 0.3::DOUBLE END DESC, page_id LIMIT 15""")
def scored_urls(spark, sf):
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    cand = p.select(i.alias("ord"), "url", F.concat_ws("#", "url", i.cast("string")).alias("_k"))
    scores = p.filter(i % 5 != 0).select(F.concat_ws("#", "url", i.cast("string")).alias("url"), (i % 11).cast("double").alias("relevance"),
                                         (i % 7).cast("double").alias("quality"), (i % 3).cast("double").alias("authority"))
    ranked = U.rank_scored(cand.withColumnRenamed("url", "link").withColumnRenamed("_k", "url"), scores)
    return ranked.select("ord", F.col("link").alias("url"), F.round("combined_score", 6).alias("combined_score"))


@query("sequential_ids", "W1", """
WITH u AS (SELECT 0 AS stream, doc_id AS a, 0 AS b FROM documents UNION ALL SELECT 1, conv_id, turn FROM conversations)
SELECT stream, a, b, printf('atom_%04d', row_number() OVER (ORDER BY stream, a, b)) AS id FROM u""")
def sequential_ids(spark, sf):
    u = table(spark, sf, "documents").select(F.lit(0).alias("stream"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        table(spark, sf, "conversations").select(F.lit(1).alias("stream"), F.col("conv_id").alias("a"), F.col("turn").alias("b")))
    return A.sequential_ids(u, [F.col("stream"), F.col("a"), F.col("b")])
