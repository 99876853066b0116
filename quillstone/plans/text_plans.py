"""Queries over text: cleaning, repair, headings, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays, constants as K, text as T
from ..operators import cleaning as C
from . import sqlparts as S
from .registry import query, table

# --- documents with page furniture planted from their own ids -----------------------------------


def noisy(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    broken = F.replace("text", F.lit(". "), F.lit(".\n"))
    planted = F.concat_ws(
        "\n",
        F.lit("Table of Contents"),
        F.concat(F.lit("Opening ..... "), (F.col("doc_id") % 90).cast("string")),
        broken,
        F.lit("House Confidential"),
        F.concat(F.lit("Page "), (F.col("doc_id") % 50).cast("string")),
        F.lit("House Confidential"), F.lit("- 12 -"), F.lit(""), F.lit("  "), F.lit("3 / 9"),
        F.lit("House Confidential"), F.lit("\tIndented  "),
        *[F.lit("x")] * 6,
    )
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, planted).otherwise(broken).alias("text"))


NOISY = f"""
noisy AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws({S.NL}, 'Table of Contents',
    'Opening ..... ' || CAST(doc_id % 90 AS VARCHAR), replace(text, '. ', '.' || {S.NL}), 'House Confidential',
    'Page ' || CAST(doc_id % 50 AS VARCHAR), 'House Confidential', '- 12 -', '', '  ', '3 / 9', 'House Confidential',
    chr(9) || 'Indented  ', 'x', 'x', 'x', 'x', 'x', 'x') ELSE replace(text, '. ', '.' || {S.NL}) END AS text
    FROM documents),
s0 AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '{T.LINE_BREAK}', {S.NL}, 'g'), '\\n\\z', ''), {S.NL}) AS l FROM noisy)"""


def _repeat_sql(src: str, dst: str, times: int, shortest: int, below: int) -> str:
    return f"""
{dst}_r AS (SELECT doc_id, list(s) AS rep FROM (SELECT doc_id, s FROM (SELECT doc_id, {S.strip('unnest(l)')} AS s FROM {src})
    WHERE length(s) >= {shortest} AND length(s) < {below} GROUP BY doc_id, s HAVING count(*) >= {times}) GROUP BY doc_id),
{dst} AS (SELECT a.doc_id, a.text, list_filter(a.l, lambda x: NOT list_contains(coalesce(rep, []), {S.strip('x')})) AS l
    FROM {src} a LEFT JOIN {dst}_r USING (doc_id))"""


_TOC = (f"regexp_matches(lower({S.strip('x')}), '^(table{T.WS}+of{T.WS}+contents|mục{T.WS}+lục|nội{T.WS}+dung)$') OR "
        f"regexp_matches({S.strip('x')}, '^.+\\.{{3,}}{T.WS}*[0-9]+$')")
_PAGE = (f"regexp_matches(lower(x), '^{T.WS}*([0-9]{{1,4}}|[-—]{T.WS}*[0-9]{{1,4}}{T.WS}*[-—]|(page|trang){T.WS}+[0-9]+|"
         f"[0-9]+{T.WS}*/{T.WS}*[0-9]+){T.WS}*$')")


def _map_sql(src: str, dst: str, expr: str) -> str:
    return f"\n{dst} AS (SELECT doc_id, text, {expr} AS l FROM {src})"


_BLANKS = (f"list_filter(l, lambda x, i: NOT (length({S.strip('x')}) = 0 AND i > 1 AND "
           f"coalesce(length({S.strip('l[i - 1]')}) = 0, false)))")
_STEPS_SQL = {
    "header_footer": lambda a, b: _repeat_sql(a, b, 3, 2, 100),
    "toc": lambda a, b: _map_sql(a, b, f"list_filter(l, lambda x: NOT ({_TOC}))"),
    "page_numbers": lambda a, b: _map_sql(a, b, f"list_filter(l, lambda x: NOT ({_PAGE}))"),
    "watermarks": lambda a, b: _repeat_sql(a, b, 6, 1, 80),
    "merge_blanks": lambda a, b: _map_sql(a, b, _BLANKS),
    "normalize_ws": lambda a, b: _map_sql(a, b, f"list_transform(l, lambda x: {S.rstrip(chr(39).join(['replace(x, chr(9), ', '    ', ')']))})"),
}


def _step_query(label: str, step, ids: str):
    sql = f"WITH {NOISY},{_STEPS_SQL[label]('s0', 's1')} SELECT doc_id, array_to_string(l, {S.NL}) AS cleaned, len(l) AS n_lines FROM s1"

    @query(f"clean_{label}", ids, sql)
    def run(spark, sf):
        d = noisy(spark, sf).withColumn("l", step(C.split_lines(F.col("text"))))
        return d.select("doc_id", F.array_join("l", "\n").alias("cleaned"), F.size("l").alias("n_lines"))


for _label, _step in C.STEPS:
    _step_query(_label, _step, {"header_footer": "C1", "toc": "C2", "page_numbers": "C4", "watermarks": "C5",
                                "merge_blanks": "C6", "normalize_ws": "C7"}[_label])


@query("clean_blank_pages", "C3", f"""
WITH b AS (SELECT doc_id, 'short' || chr(12) || replace(text, '. ', '.' || chr(12)) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(t, chr(12)), lambda s: length({S.strip('s')}) >= 50), chr(12)) AS cleaned FROM b""")
def clean_blank_pages(spark, sf):
    d = table(spark, sf, "documents")
    paged = F.concat(F.lit("short\x0c"), F.replace("text", F.lit(". "), F.lit(".\x0c")))
    return d.select("doc_id", C.drop_blank_pages(paged).alias("cleaned"))


def _full_sql() -> str:
    ctes, prev = [NOISY], "s0"
    for i, (label, _) in enumerate(C.STEPS, start=1):
        ctes.append(_STEPS_SQL[label](prev, f"s{i}"))
        prev = f"s{i}"
    n = len(C.STEPS)
    flags = " || ".join(
        f"CASE WHEN s{i - 1}.l <> s{i}.l THEN '{label},' ELSE '' END" for i, (label, _) in enumerate(C.STEPS, start=1))
    joins = " ".join(f"JOIN s{i} USING (doc_id)" for i in range(1, n + 1))
    return f"""WITH {','.join(ctes)}
SELECT doc_id, {S.strip(f'array_to_string(s{n}.l, {S.NL})')} AS cleaned, len(s0.l) AS original_lines, len(s{n}.l) AS cleaned_lines,
  len(s0.l) - len(s{n}.l) AS removed_lines, length(s0.text) AS original_chars,
  length({S.strip(f'array_to_string(s{n}.l, {S.NL})')}) AS cleaned_chars, rtrim({flags}, ',') AS steps_applied
FROM s0 {joins}"""


@query("clean_transcript", "C8 S1", _full_sql())
def clean_transcript(spark, sf):
    d = C.clean(noisy(spark, sf), blank=True)
    return d.select(
        "doc_id", "cleaned",
        *[F.col(f"clean_stats.{c}").alias(c) for c in (
            "original_lines", "cleaned_lines", "removed_lines", "original_chars", "cleaned_chars")],
        F.array_join("clean_stats.steps_applied", ",").alias("steps_applied"),
    )


# --- unsafe characters --------------------------------------------------------------------------


def _messy() -> F.Column:
    extra = "\x07\x01\x07\x85\x9f\U0001f600�\n\n\n\né\xa0 \t x \n\n\n\nend"
    return F.concat(F.lit("\ufeff"), F.col("text"), F.lit(extra))


_MESSY = ("chr(65279) || text || chr(7) || chr(1) || chr(7) || chr(133) || chr(159) || chr(57344) || chr(128512) || chr(65533)"
          " || chr(10) || chr(10) || chr(10) || chr(10) || 'e' || chr(769) || chr(160) || ' ' || chr(9) || ' x ' || chr(10) || chr(10)"
          " || chr(10) || chr(10) || 'end'")
_BAD = (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{feff}\x{fffe}\x{fff0}-\x{ffff}\x{e000}-\x{f8ff}\x{10000}-\x{10ffff}]")
_SPACES = r"[\t\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BAD_API = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{feff}\x{fffd}-\x{ffff}\x{e000}-\x{f8ff}\x{10000}-\x{10ffff}]"


@query("sanitise_ocr", "C9 F1", f"""
WITH m AS (SELECT doc_id, {_MESSY} AS t FROM documents),
c AS (SELECT doc_id, nfc_normalize(t) AS n, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(t), '{_BAD}', '', 'g'), '{_SPACES}', ' ', 'g'), '\\n{{3,}}', {S.NL} || {S.NL}, 'g') AS t FROM m)
SELECT doc_id, {S.strip(f"array_to_string(list_transform(string_split(t, {S.NL}), lambda x: rtrim(x, ' ')), {S.NL})")} AS for_text,
  regexp_replace(n, '{_BAD_API}', '', 'g') AS for_request FROM c""")
def sanitise_ocr(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.nfc(_messy()).alias("t"))
    return d.select("doc_id", C.sanitise_ocr(F.col("t"), compose=False).alias("for_text"),
                    C.sanitise_request(F.col("t"), compose=False).alias("for_request"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
_MARK = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{10000}-\x{10ffff}]"


@query("character_diagnostics", "C10", f"""
WITH m AS (SELECT doc_id, {_MESSY} AS t FROM documents),
k AS (SELECT doc_id, string_agg(c || '=' || n, ',' ORDER BY c) AS control_chars FROM (
   SELECT doc_id, '\\x' || lower(format('{{:02x}}', unicode(c))) AS c, count(*) AS n FROM (
     SELECT doc_id, unnest(regexp_extract_all(t, '{_CTRL}')) AS c FROM m) GROUP BY 1, 2) GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(CASE WHEN u > 65535 THEN 'Non-BMP U+' || upper(format('{{:04x}}', u)) WHEN u >= 127 THEN 'C1 control \\x' || format('{{:02x}}', u)
   ELSE 'Control \\x' || format('{{:02x}}', u) END || ' at pos ' || i, '; ' ORDER BY i) AS sample_problems
   FROM (SELECT doc_id, unicode(c) AS u, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
     SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) - 1 AS i FROM m)
     WHERE regexp_matches(c, '{_MARK}')) WHERE r <= 10 GROUP BY doc_id)
SELECT doc_id, length(t) AS length, contains(t, chr(65279)) AS has_bom, k.control_chars, len(regexp_extract_all(t, '[\\x{{10000}}-\\x{{10ffff}}]')) AS non_bmp_count,
  len(regexp_extract_all(t, '\\x{{fffd}}')) AS replacement_char_count, len(regexp_extract_all(t, '[\\x{{e000}}-\\x{{f8ff}}]')) AS pua_count, p.sample_problems
FROM m JOIN k USING (doc_id) JOIN p USING (doc_id)""")
def character_diagnostics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _messy().alias("t"))
    d = d.select("doc_id", C.diagnose(F.col("t")).alias("g"))
    ctrl = F.array_join(F.array_sort(F.transform(
        F.map_entries("g.control_chars"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return d.select("doc_id", "g.length", "g.has_bom", ctrl.alias("control_chars"), "g.non_bmp_count",
                    "g.replacement_char_count", "g.pua_count", F.array_join("g.sample_problems", "; ").alias("sample_problems"))


# --- pages --------------------------------------------------------------------------------------


def _book(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    body = F.replace("text", F.lit(", "), F.lit("-\n"))
    page = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("HOUSE MANUAL\n"), body, F.lit("\n\n\n\n17\nend of page")))
    return c.select("conv_id", "turn", page.otherwise(F.concat(F.lit("Part One\n"), body)).alias("text"))


_BOOK = f"""book AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'HOUSE MANUAL' || {S.NL} || replace(text, ', ', '-' || {S.NL})
   || {S.NL} || {S.NL} || {S.NL} || {S.NL} || '17' || {S.NL} || 'end of page' ELSE 'Part One' || {S.NL} || replace(text, ', ', '-' || {S.NL}) END AS text FROM conversations)"""


def _repair_sql(x: str) -> str:
    return S.strip(f"regexp_replace(regexp_replace(regexp_replace({x}, '({T.WORD})-\\n({T.WORD})', '\\1\\2', 'g'), '\\n{{3,}}', {S.NL} || {S.NL}, 'g'), '(?m)^\\s*\\d+\\s*$', '', 'g')")


@query("repair_page_text", "C11", f"WITH {_BOOK} SELECT conv_id, turn, {_repair_sql('text')} AS text FROM book")
def repair_page_text(spark, sf):
    return _book(spark, sf).select("conv_id", "turn", C.repair_page(F.col("text")).alias("text"))


_EDGES = f"""
e AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, {S.NL}), lambda x: {S.strip('x')}), lambda x: length(x) > 0) AS b FROM book),
n AS (SELECT conv_id, count(*) AS n_pages FROM book GROUP BY conv_id),
h AS (SELECT conv_id, line, c FROM (SELECT conv_id, b[1] AS line, count(*) AS c, min(turn) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS r FROM e WHERE len(b) > 0 GROUP BY 1, 2) WHERE r = 1),
t AS (SELECT conv_id, line, c FROM (SELECT conv_id, b[-1] AS line, count(*) AS c, min(turn) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS r FROM e WHERE len(b) > 0 GROUP BY 1, 2) WHERE r = 1),
hf AS (SELECT n.conv_id, n_pages, CASE WHEN n_pages >= 3 AND h.c > n_pages * 0.5 THEN h.line ELSE '' END AS header,
   CASE WHEN n_pages >= 3 AND t.c > n_pages * 0.5 THEN t.line ELSE '' END AS footer FROM n LEFT JOIN h USING (conv_id) LEFT JOIN t USING (conv_id))"""


@query("page_header_footer", "C12", f"WITH {_BOOK}, {_EDGES} SELECT * FROM hf")
def page_header_footer(spark, sf):
    return C.find_header_footer(_book(spark, sf), "conv_id", "turn", "text")


def _level_sql(x: str) -> str:
    s = S.strip(x)
    return (f"CASE WHEN length({s}) = 0 OR length({s}) > 100 THEN 0 WHEN upper({s}) = {s} AND lower({s}) <> {s} AND length({s}) > 3 THEN 1 "
            f"WHEN regexp_matches({s}, '\\p{{Lu}}') AND NOT regexp_matches({s}, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches({s}, '\\p{{L}}\\p{{Lu}}') "
            f"AND NOT regexp_matches({s}, '[.,;:?!]$') AND length({s}) < 60 THEN 2 ELSE 0 END")


@query("heading_levels", "C13", f"""WITH {NOISY}, x AS (SELECT doc_id, unnest(l) AS x FROM s0)
SELECT doc_id, CAST(sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) AS BIGINT) AS level_1, CAST(sum(CASE WHEN lv = 2 THEN 1 ELSE 0 END) AS BIGINT) AS level_2, count(*) AS n_lines
FROM (SELECT doc_id, {_level_sql('x')} AS lv FROM x) GROUP BY doc_id""")
def heading_levels(spark, sf):
    d = noisy(spark, sf).filter(F.col("text").isNotNull()).select("doc_id", F.transform(C.split_lines(F.col("text")), lambda x: C.heading_level(x)).alias("lv"))

    def n(level: int):
        return F.size(F.filter("lv", lambda v: v == level)).cast("long")

    return d.select("doc_id", n(1).alias("level_1"), n(2).alias("level_2"), F.size("lv").cast("long").alias("n_lines"))


@query("assemble_pages", "C14", f"""
WITH {_BOOK}, {_EDGES},
a AS (SELECT conv_id, turn, header, footer, CASE WHEN header <> '' THEN {S.strip("CASE WHEN instr(text, header) > 0 THEN substring(text, 1, instr(text, header) - 1) || substring(text, instr(text, header) + length(header)) ELSE text END")} ELSE text END AS text FROM book JOIN hf USING (conv_id)),
b AS (SELECT conv_id, turn, {S.strip("CASE WHEN footer <> '' AND contains(text, footer) THEN substring(text, 1, length(text) - instr(reverse(text), reverse(footer)) - length(footer) + 1) || substring(text, length(text) - instr(reverse(text), reverse(footer)) + 2) ELSE text END")} AS text FROM a),
c AS (SELECT conv_id, turn, {_repair_sql('text')} AS text FROM b),
m AS (SELECT conv_id, turn, '## Page ' || (turn + 1) || {S.NL} || {S.NL} || array_to_string(list_transform(string_split(text, {S.NL}),
    lambda x: CASE WHEN {_level_sql('x')} > 0 THEN {S.NL} || repeat('#', {_level_sql('x')} + 1) || ' ' || {S.strip('x')} || {S.NL} ELSE x END), {S.NL}) || {S.NL} AS md FROM c WHERE length(text) > 0 AND turn < 500)
SELECT conv_id, {S.strip(f"string_agg(md, {S.NL} ORDER BY turn)")} AS markdown FROM m GROUP BY conv_id""")
def assemble_pages(spark, sf):
    return C.assemble_pages(_book(spark, sf), "conv_id", "turn", "text")


# --- scalar functions ---------------------------------------------------------------------------


@query("size_estimates", "C22", f"""
SELECT doc_id, length(text) // 4 AS tokens, {S.words('text')} AS words, CASE WHEN contains(text || CASE WHEN doc_id % 5 = 0 THEN '## Page 1 ## Page 2 ' ELSE '' END, '## Page ') THEN 2
  ELSE greatest(1, {S.words('text')} // 500) END AS pages FROM documents""")
def size_estimates(spark, sf):
    d = table(spark, sf, "documents")
    marked = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "## Page 1 ## Page 2 ").otherwise(""))
    counted = d.select("doc_id", "text", marked.alias("marked"), T.word_count(F.col("text")).alias("n"))
    # what is appended holds markers, so where words count they are those of the text
    return counted.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.col("n").cast("long").alias("words"),
                          T.page_count(F.col("marked"), F.col("n")).alias("pages"))


def _keyword_query(name: str, k: int, stop, shortest: int = 3, longest=None):
    @query(f"keywords_{name}", "K1", f"WITH {S.keywords('kw', 'documents', 'doc_id', 'text', k, stop, shortest, longest)} "
           "SELECT doc_id, coalesce(string_agg(kw, ' ' ORDER BY r), '') AS keywords, count(kw) AS n FROM documents LEFT JOIN kw ON id = doc_id GROUP BY doc_id")
    def run(spark, sf):
        kw = T.keywords(F.col("text"), k, tuple(stop), shortest, longest)
        d = table(spark, sf, "documents").select("doc_id", kw.alias("k"))
        return d.select(
            "doc_id", F.array_join("k", " ").alias("keywords"), F.size("k").cast("long").alias("n"))


_keyword_query("audit", 15, K.STOP_AUDIT)
_keyword_query("extract", 8, K.STOP_EXTRACT)
_keyword_query("verify", 10, K.STOP_VERIFY)
_keyword_query("parser", 10, K.STOP_PARSER)
_keyword_query("baseline", 20, (), 4, 30)


@query("keyword_sets", "K2", f"""WITH {S.keyword_set('kw', 'documents', 'doc_id', 'text', K.STOP_DEDUP)}
SELECT doc_id, count(kw) AS n, coalesce(string_agg(kw, ' ' ORDER BY kw), '') AS keywords FROM documents LEFT JOIN kw ON id = doc_id GROUP BY doc_id""")
def keyword_sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.keyword_set(F.col("text"), tuple(K.STOP_DEDUP)).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n"), F.array_join(F.sort_array("k"), " ").alias("keywords"))


@query("numbers_and_negation", "K5 K6", f"""
WITH t AS (SELECT doc_id, text || ' 5% of 12.50 and 7' AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{T.NUMBER}'))), ' ') AS numbers, {S.any_of('lower(t)', K.NEGATIONS)} AS negated FROM t""")
def numbers_and_negation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" 5% of 12.50 and 7")).alias("t"))
    return d.select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("t"))), " ").alias("numbers"),
                    T.has_negation(F.col("t"), K.NEGATIONS).alias("negated"))


def _title() -> F.Column:
    return F.substring_index("text", "\n", 1)


_TITLE = f"string_split(text, {S.NL})[1]"


@query("embedding_texts", "K9", f"""
SELECT doc_id, {_TITLE} || ': ' || left(text, 200) AS for_dedup, source || ': ' || left(text, 300) AS for_reference, {_TITLE} || ': ' || left(text, 300) AS for_verify FROM documents""")
def embedding_texts(spark, sf):
    d = table(spark, sf, "documents")

    def build(label, n):
        return F.concat(label, F.lit(": "), F.left("text", F.lit(n)))

    return d.select("doc_id", build(_title(), 200).alias("for_dedup"), build(F.col("source"), 300).alias("for_reference"),
                    build(_title(), 300).alias("for_verify"))


@query("content_keys", "K10", """
SELECT doc_id, left(sha256(text), 16) AS text_key, left(sha256(concat_ws(':', left(sha256(text), 16), 'm1', 'v3', source)), 16) AS cache_key,
 'bl_' || left(sha256(source || lang), 10) AS entry_id FROM documents""")
def content_keys(spark, sf):
    d = table(spark, sf, "documents")
    key = T.content_key(F.col("text"))
    return d.select("doc_id", key.alias("text_key"), T.content_key(key, F.lit("m1"), F.lit("v3"), F.col("source")).alias("cache_key"),
                    F.concat(F.lit("bl_"), T.content_key(F.concat("source", "lang"), length=10)).alias("entry_id"))


_NOTE_SQL = """CASE WHEN doc_id % 4 = 0 THEN 'Verified (score 0.' || (doc_id % 90 + 10) || ') against ref' WHEN doc_id % 4 = 1 THEN 'score 1.2.3' WHEN doc_id % 4 = 2 THEN 'score  0' ELSE lang END"""


def _note() -> F.Column:
    i = F.col("doc_id")
    return (F.when(i % 4 == 0, F.concat(F.lit("Verified (score 0."), (i % 90 + 10).cast("string"), F.lit(") against ref")))
            .when(i % 4 == 1, "score 1.2.3").when(i % 4 == 2, "score  0").otherwise(F.col("lang")))


@query("score_from_note", "K11", f"SELECT doc_id, TRY_CAST(nullif(regexp_extract({_NOTE_SQL}, 'score{T.WS}+([0-9.]+)', 1), '') AS DOUBLE) AS score FROM documents")
def score_from_note(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.noted_score(_note()).alias("score"))


@query("snippets", "K12", """
WITH k AS (SELECT doc_id, text, lower(text) AS low, [lower(source), 'the', 'de', 'en'] AS ks FROM documents),
p AS (SELECT doc_id, text, list_filter(list_transform(ks, lambda x: instr(low, x) - 1), lambda p: p >= 0)[1] AS pos FROM k),
c AS (SELECT doc_id, text, pos, greatest(0, pos - 200) AS s, least(length(text), pos + 200) AS e FROM p)
SELECT doc_id, CASE WHEN pos IS NULL THEN left(text, 200) ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || """ + S.strip("substring(text, s + 1, e - s)") + """
  || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS snippet, CASE WHEN pos IS NULL THEN 0 ELSE s END AS snippet_start,
  CASE WHEN pos IS NULL THEN least(length(text), 200) ELSE e END AS snippet_end FROM c""")
def snippets(spark, sf):
    needles = F.array(F.lower("source"), F.lit("the"), F.lit("de"), F.lit("en"))
    d = table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), needles).alias("s"))
    return d.select("doc_id", F.col("s.snippet").alias("snippet"), F.col("s.start").alias("snippet_start"), F.col("s.end").alias("snippet_end"))


def _cut_sql(limit: int) -> str:
    parts = [f"WHEN length(text) <= {limit} THEN text"]
    for sep in (". ", ".\n", "? ", "!\n", "! "):
        lit, rev = S.q(sep), S.q(sep[::-1])
        at = f"(length(h) - instr(reverse(h), {rev}) - 1)"
        parts.append(f"WHEN contains(h, {lit}) AND {at} > {limit * 0.5} THEN {S.rstrip(f'left(h, {at} + 1)')}")
    sp = "(length(h) - instr(reverse(h), ' '))"
    parts.append(f"WHEN contains(h, ' ') AND {sp} > {limit * 0.5} THEN {S.rstrip(f'left(h, {sp})')}")
    return f"CASE {' '.join(parts)} ELSE {S.rstrip('h')} END"


@query("cut_at_sentence", "K13", f"WITH d AS (SELECT doc_id, text, left(text, 300) AS h FROM documents) SELECT doc_id, {_cut_sql(300)} AS cut FROM d")
def cut_at_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cut_at_sentence(F.col("text"), 300).alias("cut"))


@query("structural_checks", "K14", f"""
SELECT doc_id, regexp_matches({S.rstrip('text')}, '[.!?。…]$') AS ends_sentence, length(text) BETWEEN 100 AND 2000 AS length_ok,
 {S.words(_TITLE)} >= 3 AS title_ok, lang <> 'general' AS category_ok FROM documents""")
def structural_checks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.ends_sentence(F.col("text")).alias("ends_sentence"), F.length("text").between(100, 2000).alias("length_ok"),
                    (T.word_count(_title()) >= 3).alias("title_ok"), (F.col("lang") != "general").alias("category_ok"))


@query("topic_labels", "K15", f"""
WITH t AS (SELECT source, doc_id, {S.strip(f'left({_TITLE}, 40)')} AS title FROM documents),
r AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM t WHERE title <> '')
SELECT source, string_agg(title, ', ' ORDER BY r) AS topics FROM r WHERE r <= 30 GROUP BY source""")
def topic_labels(spark, sf):
    from ..operators.publish import top_labels

    d = table(spark, sf, "documents").select("source", "doc_id", T.strip(F.left(_title(), F.lit(40))).alias("title"))
    return top_labels(d, "source", "doc_id", "title", 30).withColumnRenamed("labels", "topics")


# --- pairwise scalar similarity, on neighbours ---------------------------------------------------


@query("pair_similarity_functions", "K3 K4", f"""
WITH {S.keyword_set('kw', 'documents', 'doc_id', 'text', K.STOP_DEDUP)},
w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '{T.WORD}+')) AS t FROM documents),
p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)),
ks AS (SELECT id, count(*) AS n FROM kw GROUP BY id), ws AS (SELECT id, count(*) AS n FROM w GROUP BY id),
ki AS (SELECT p.a, count(*) AS n FROM p JOIN kw x ON x.id = a JOIN kw y ON y.id = b AND y.kw = x.kw GROUP BY p.a),
wi AS (SELECT p.a, count(*) AS n FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b AND y.t = x.t GROUP BY p.a)
SELECT p.a AS doc_a, p.b AS doc_b, round(coalesce(CAST(ki.n AS DOUBLE) / least(ka.n, kb.n), 0), 6) AS overlap,
 round(CASE WHEN wa.n IS NULL AND wb.n IS NULL THEN 1.0 ELSE coalesce(wi.n, 0)::DOUBLE / (coalesce(wa.n, 0) + coalesce(wb.n, 0) - coalesce(wi.n, 0)) END, 6) AS jaccard
FROM p LEFT JOIN ki ON ki.a = p.a LEFT JOIN wi ON wi.a = p.a LEFT JOIN ks ka ON ka.id = p.a LEFT JOIN ks kb ON kb.id = p.b
LEFT JOIN ws wa ON wa.id = p.a LEFT JOIN ws wb ON wb.id = p.b""")
def pair_similarity_functions(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", T.keyword_set(F.col("text"), tuple(K.STOP_DEDUP)).alias("k"), F.array_distinct(T.tokens(F.col("text"), 1)).alias("w"))
    a = d.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"), F.col("k").alias("ka"), F.col("w").alias("wa"))
    b = d.select(F.col("doc_id").alias("doc_b"), F.col("k").alias("kb"), F.col("w").alias("wb"))
    return a.join(b, "doc_b").select("doc_a", "doc_b", F.round(T.overlap(F.col("ka"), F.col("kb")), 6).alias("overlap"),
                                     F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query("vector_cosine", "K7", """
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(greatest(0, least(1, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
 (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a = e.select(F.col("vec_id").alias("vec_a"), (F.col("vec_id") + 1).alias("vec_b"), F.col("v").alias("va"))
    b = e.select(F.col("vec_id").alias("vec_b"), F.col("v").alias("vb"))
    return a.join(b, "vec_b").select("vec_a", "vec_b", F.round(T.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))
