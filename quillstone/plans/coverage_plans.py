"""Queries that compare documents with the reference passages of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, text as T
from ..operators import coverage as C, evidence as E, lookup as L
from . import sqlparts as S
from .registry import query, table

_SENTENCE = "^[^.\\n]*"


def _topic():
    return F.regexp_extract("text", _SENTENCE, 0)


_TOPIC_SQL = f"regexp_extract(text, '{_SENTENCE}')"


def _refs(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ref_idx"), F.concat(F.lit("ref_"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"))


def _best(kw: str, name: str = "best", src: str = "benchmark") -> str:
    """CTE: best reference per id by number of contained keywords, ties to the lower index."""
    return f"""
    {name}_c AS (SELECT k.id, b.item_id AS ref_idx, count(*) AS n FROM {kw} k JOIN {src} b ON contains(lower(b.text), k.kw) GROUP BY 1, 2),
    {name} AS (SELECT id, ref_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, ref_idx) AS r FROM {name}_c) WHERE r = 1)"""


@query("evidence_search", "J4", f"""
WITH {S.keywords('kw', 'documents', 'doc_id', 'text', 10, K.STOP_VERIFY)}, {_best('kw')},
t AS (SELECT id, count(*) AS total, list(kw ORDER BY r) AS ks FROM kw GROUP BY id),
j AS (SELECT d.doc_id, coalesce(total, 0) AS total, b.ref_idx, coalesce(CAST(n AS DOUBLE) / total * 100, 0) AS score, m.text AS content,
  list_filter(ks, lambda k: contains(lower(m.text), k)) AS matched FROM documents d LEFT JOIN t ON t.id = d.doc_id LEFT JOIN best b ON b.id = d.doc_id LEFT JOIN benchmark m ON m.item_id = b.ref_idx),
p AS (SELECT *, instr(lower(content), matched[1]) - 1 AS pos FROM j),
s AS (SELECT *, greatest(0, pos - 200) AS s0, least(length(content), pos + 200) AS e0 FROM p)
SELECT doc_id, score >= 40 AS found, CASE WHEN score > 0 THEN 'ref_' || ref_idx || '.md' END AS file, round_even(score, 1) AS match_score,
 CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'weak' ELSE 'none' END AS band, coalesce(array_to_string(matched, ' '), '') AS keywords_matched, total AS keywords_total,
 CASE WHEN score >= 40 THEN CASE WHEN s0 > 0 THEN '...' ELSE '' END || {S.strip('substring(content, s0 + 1, e0 - s0)')} || CASE WHEN e0 < length(content) THEN '...' ELSE '' END END AS snippet,
 CASE WHEN score >= 40 THEN s0 END AS snippet_start, CASE WHEN score >= 40 THEN e0 END AS snippet_end FROM s""")
def evidence_search(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = E.search(d, "doc_id", "text", _refs(spark, sf), "ref_idx", "path", "content")
    return e.withColumn("keywords_matched", F.array_join("keywords_matched", " "))


@query("evidence_status", "J4", f"""
WITH {S.keywords('kw', 'documents', 'doc_id', 'text', 10, K.STOP_VERIFY)}, {_best('kw')},
t AS (SELECT id, count(*) AS total FROM kw GROUP BY id),
j AS (SELECT d.doc_id, total, n, b.ref_idx, coalesce(CAST(n AS DOUBLE) / total * 100, 0) AS score, 0.5::DOUBLE + CAST(doc_id % 50 AS DOUBLE) / 100 AS c FROM documents d LEFT JOIN t ON t.id = d.doc_id LEFT JOIN best b ON b.id = d.doc_id)
SELECT doc_id, CASE WHEN score >= 40 THEN 'verified' ELSE 'unverified' END AS status, round(CASE WHEN score >= 40 THEN least(1.0, c + 0.05) ELSE c END, 6) AS confidence,
 CASE WHEN score >= 40 THEN format('Verified against ref_{{}}.md ({{}}/{{}} keywords, {{:.1f}}% match)', ref_idx, n, total, round_even(score, 1)) ELSE 'Expert insight — not found in official docs' END AS verification_note,
 CASE WHEN score >= 40 THEN 'ref_' || ref_idx || '.md' END AS baseline_reference FROM j""")
def evidence_status(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", (F.lit(0.5) + (F.col("doc_id") % 50).cast("double") / 100).alias("confidence"))
    e = E.search(d, "doc_id", "text", _refs(spark, sf), "ref_idx", "path", "content")
    a = E.apply_evidence(d.drop("text"), e, "doc_id")
    return a.select("doc_id", "status", F.round("confidence", 6).alias("confidence"), "verification_note", "baseline_reference")


@query("verification_score", "A10", f"""
WITH {S.keywords('kw', 'documents', 'doc_id', 'text', 10, K.STOP_VERIFY)}, {_best('kw')},
t AS (SELECT id, count(*) AS total FROM kw GROUP BY id),
j AS (SELECT d.doc_id, coalesce(round_even(CAST(n AS DOUBLE) / total * 100, 1), 0) AS score, coalesce(CAST(n AS DOUBLE) / total * 100, 0) >= 40 AS found FROM documents d LEFT JOIN t ON t.id = d.doc_id LEFT JOIN best b ON b.id = d.doc_id)
SELECT round(least(100, greatest(0, sum(found::INT)::DOUBLE / greatest(count(*), 1) * 50 + coalesce(avg(CASE WHEN found THEN score END), 0) / 100 * 30 + 1.0 * 20)), 6) AS score, sum(found::INT)::BIGINT AS verified, count(*) AS sampled FROM j""")
def verification_score(spark, sf):
    from ..operators.scores import verification

    d = table(spark, sf, "documents").select("doc_id", "text")
    e = E.search(d, "doc_id", "text", _refs(spark, sf), "ref_idx", "path", "content")
    return verification(e, 100).withColumn("score", F.round("score", 6))


@query("topic_reference_match", "J1", f"""
WITH {S.keywords('kw', 'documents', 'doc_id', _TOPIC_SQL, 8, K.STOP_AUDIT)}, {_best('kw')}
SELECT doc_id, {_TOPIC_SQL} AS topic, coalesce(n >= 2, false) AS found, ref_idx, coalesce(n, 0) AS match_count FROM documents LEFT JOIN best ON id = doc_id""")
def topic_reference_match(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _topic().alias("topic"))
    return C.match_topics(d, "doc_id", "topic", _refs(spark, sf), "ref_idx", "content")


_GAPS = f"""{S.keywords('tk', 'documents', 'doc_id', _TOPIC_SQL, 5, K.STOP_AUDIT)}, {S.keywords('bk', 'benchmark', 'item_id', _TOPIC_SQL, 5, K.STOP_AUDIT)},
cov AS (SELECT DISTINCT b FROM (SELECT bk.id AS b, tk.id AS t FROM bk JOIN tk USING (kw) GROUP BY 1, 2 HAVING count(*) >= 2)),
gaps AS (SELECT item_id, {_TOPIC_SQL} AS topic FROM benchmark WHERE item_id IN (SELECT id FROM bk) AND item_id NOT IN (SELECT b FROM cov))"""


def _baseline_topics(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", _topic().alias("topic"))


@query("baseline_gaps", "J2", f"WITH {_GAPS} SELECT item_id, topic FROM gaps")
def baseline_gaps(spark, sf):
    t = table(spark, sf, "documents").select(_topic().alias("topic"))
    return C.uncovered(_baseline_topics(spark, sf), t, "topic")


_MATRIX = f"""{S.keywords('kw', 'documents', 'doc_id', _TOPIC_SQL, 8, K.STOP_AUDIT)}, {_best('kw')}, {_GAPS},
m AS (SELECT {_TOPIC_SQL} AS topic, 'transcript' AS source, CASE WHEN n >= 2 THEN 'OVERLAP' ELSE 'UNIQUE_EXPERT' END AS status, CASE WHEN n >= 2 THEN n END AS match_count
  FROM documents LEFT JOIN best ON id = doc_id UNION ALL SELECT topic, 'baseline', 'GAP_TO_FILL', NULL FROM gaps)"""


def _matrix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _topic().alias("topic"))
    m = C.match_topics(d, "doc_id", "topic", _refs(spark, sf), "ref_idx", "content")
    return C.coverage_matrix(m, C.uncovered(_baseline_topics(spark, sf), d, "topic"), "topic")


@query("coverage_matrix", "J3", f"WITH {_MATRIX} SELECT * FROM m")
def coverage_matrix(spark, sf):
    return _matrix(spark, sf)


@query("coverage_summary", "J3", f"""WITH {_MATRIX}
SELECT count(*) FILTER (status = 'OVERLAP') AS overlap_count, count(*) FILTER (status = 'UNIQUE_EXPERT') AS unique_expert_count, count(*) FILTER (status = 'GAP_TO_FILL') AS gap_count, count(*) AS total,
 round_even(count(*) FILTER (status <> 'GAP_TO_FILL')::DOUBLE / greatest(count(*), 1) * 100, 1) AS coverage_score FROM m""")
def coverage_summary(spark, sf):
    return C.coverage_summary(_matrix(spark, sf))


@query("gap_excerpts", "J6", f"""
WITH {S.keywords('kw', 'documents', 'doc_id', _TOPIC_SQL, 8, K.STOP_EXTRACT)},
c AS (SELECT k.id, b.item_id AS ref_idx, b.text, count(*) AS n, min(instr(lower(b.text), k.kw) - 1) AS f FROM kw k JOIN benchmark b ON contains(lower(b.text), k.kw) GROUP BY 1, 2, 3),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, length(text), ref_idx) AS r FROM c) WHERE r = 1)
SELECT id AS doc_id, ref_idx, n AS match_count, substring(text, greatest(0, f - 6000) + 1, 12000) AS excerpt FROM w""")
def gap_excerpts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _topic().alias("topic"))
    return C.gap_excerpts(d, "doc_id", "topic", _refs(spark, sf), "ref_idx", "content")


# --- lookup --------------------------------------------------------------------------------------


def _entries(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("text").alias("content"), _topic().alias("title"),
        T.keywords(F.col("text"), 10, tuple(K.STOP_PARSER)).alias("keywords"))


def _searched():
    return F.concat_ws("\n", "title", "content")


def _hits(limit: int, src: str, id_: str, topic: str) -> str:
    return f"""
    w_a AS (SELECT {id_} AS id, {S.word_list(f'lower({topic})')} AS l FROM {src}),
    w AS (SELECT id, unnest(list_filter(l, lambda x: length(x) >= 3)) AS kw, generate_subscripts(list_filter(l, lambda x: length(x) >= 3), 1) AS p FROM w_a),
    h_a AS (SELECT w.id, b.item_id AS ord, min(p) AS p FROM w JOIN benchmark b ON contains(lower(b.text), w.kw) GROUP BY 1, 2),
    h AS (SELECT id, ord, r - 1 AS position FROM (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY p, ord) AS r FROM h_a) WHERE r <= {limit})"""


@query("topic_lookup", "J12", f"WITH {_hits(5, 'documents', 'doc_id', _TOPIC_SQL)} SELECT id AS doc_id, ord, position FROM h")
def topic_lookup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _topic().alias("topic"))
    return L.lookup(d, "doc_id", "topic", _entries(spark, sf), "ord", _searched(), 5)


@query("claim_check", "J13", f"""
WITH claims AS (SELECT conv_id * 100 + turn AS id, text FROM conversations UNION ALL SELECT 1000000 + item_id, text FROM benchmark),
{_hits(3, 'claims', 'id', 'left(text, 100)')},
c AS (SELECT id, list_distinct({S.word_list('lower(text)')}) AS l FROM claims), e AS (SELECT item_id, text, list_distinct({S.word_list('lower(text)')}) AS l FROM benchmark),
s AS (SELECT h.id, h.ord, position, e.text, len(list_intersect(c.l, e.l))::DOUBLE / greatest(len(c.l), 1) AS score FROM h JOIN c USING (id) JOIN e ON e.item_id = h.ord),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, position) AS r FROM s) WHERE r = 1)
SELECT claims.id, coalesce(score, 0) > 0.3 AS verified, round_even(coalesce(score, 0), 2) AS confidence, CASE WHEN score > 0 THEN ord END AS ord, CASE WHEN score > 0 THEN left(b.text, 500) ELSE '' END AS evidence,
 CASE WHEN score > 0.7 THEN 'exact' WHEN score > 0.3 THEN 'partial' ELSE 'no_match' END AS match_type FROM claims LEFT JOIN b USING (id)""")
def claim_check(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    b = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("id"), "text")
    claims = c.unionByName(b).withColumn("topic", F.left("text", F.lit(100)))
    out = L.verify_claims(claims, "id", "text", "topic", _entries(spark, sf), "ord", _searched(), "content")
    return out.drop("text", "topic")


@query("lookup_coverage", "J14", f"""
WITH {_hits(1, 'documents', 'doc_id', _TOPIC_SQL)}, {S.keywords('bk', 'benchmark', 'item_id', 'text', 10, K.STOP_PARSER)}, n AS (SELECT id, count(*) AS n FROM bk GROUP BY id)
SELECT doc_id, h.ord IS NOT NULL AS covered, CASE WHEN h.ord IS NULL THEN 0 ELSE 1 END AS entries_count, coalesce(n.n / 10.0, 0)::DOUBLE AS confidence
FROM documents LEFT JOIN h ON h.id = doc_id LEFT JOIN n ON n.id = h.ord""")
def lookup_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _topic().alias("topic"))
    return L.lookup_coverage(d, "doc_id", "topic", _entries(spark, sf), "ord", _searched(), "keywords").drop("topic")


# --- topics --------------------------------------------------------------------------------------

_FIRST_WORD = f"{S.word_list('text')}[1]"


def _mentions(spark, sf):
    return table(spark, sf, "documents").select(
        T.first_word(F.col("text")).alias("topic"), "doc_id", "source", "lang",
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5).alias("mentions"), (F.col("doc_id") % 10).alias("quality_score"))


@query("topic_merge", "A1", f"""
SELECT lower({_FIRST_WORD}) AS topic_key, sum(CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 ELSE 1 END)::BIGINT AS mentions, max(doc_id % 10) AS quality_score, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1""")
def topic_merge(spark, sf):
    return C.merge_topics(_mentions(spark, sf), "topic", "doc_id", ["lang"])


@query("topic_files", "A1", f"""
SELECT topic_key, source, row_number() OVER (PARTITION BY topic_key ORDER BY f) AS pos FROM (SELECT lower({_FIRST_WORD}) AS topic_key, source, min(doc_id) AS f FROM documents GROUP BY 1, 2)""")
def topic_files(spark, sf):
    return C.topic_files(_mentions(spark, sf), "topic", "doc_id", "source")
