"""Queries over atoms and builds: dedup, verification, scorecards, publishing, registries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K, text as T
from ..operators import (
    batching as B, conflicts as X, coverage as C, dedup as D, evidence as E, incremental as I, publish as P, scores as R,
    similarity as Z)
from ..operators.urls import top_rows
from ..session import materialise, shared_dir
from . import sqlparts as S
from .registry import query, table
from .similarity_plans import _TEXT200, _texts, tfidf_sql
from .text_plans import _NOTE_SQL, _TITLE, _note

# --- documents as atoms --------------------------------------------------------------------------

_STATUSES = ["flagged", "verified", "updated", "raw", "raw", "verified"]


def _atoms(spark, sf):
    i = F.col("doc_id")
    odd = F.substring("source", 4, 9).cast("int") % 2
    return table(spark, sf, "documents").select(
        i.alias("idx"), F.format_string("atom_%04d", i).alias("id"), F.left(F.substring_index("text", "\n", 1), F.lit(40)).alias("title"),
        F.col("text").alias("content"), F.col("lang").alias("category"),
        F.when(i % 3 == 0, F.array("lang")).otherwise(F.array("lang", "source")).alias("tags"), F.col("source").alias("build"),
        F.when(i % 10 == 9, "codebase").when(odd == 0, "transcript").otherwise("baseline").alias("source"),
        (F.lit(0.5) + (i * 37 % 51).cast("double") / 100).alias("confidence"),
        F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (i % 6 + 1).cast("int")).alias("status"),
        _note().alias("verification_note"), F.when(i % 5 == 0, F.concat(F.lit("ref_"), F.col("lang"), F.lit(".md"))).alias("baseline_reference"),
        (i % 4 == 0).alias("gap_filled"))


_ATOMS = f"""atoms AS (SELECT doc_id AS idx, printf('atom_%04d', doc_id) AS id, left({_TITLE}, 40) AS title, text AS content, lang AS category,
 CASE WHEN doc_id % 3 = 0 THEN [lang] ELSE [lang, source] END AS tags, source AS build,
 CASE WHEN doc_id % 10 = 9 THEN 'codebase' WHEN CAST(substring(source, 4) AS INT) % 2 = 0 THEN 'transcript' ELSE 'baseline' END AS source,
 0.5::DOUBLE + (doc_id * 37 % 51)::DOUBLE / 100 AS confidence, ([{', '.join(S.q(s) for s in _STATUSES)}])[doc_id % 6 + 1] AS status,
 {_NOTE_SQL} AS verification_note, CASE WHEN doc_id % 5 = 0 THEN 'ref_' || lang || '.md' END AS baseline_reference, doc_id % 4 = 0 AS gap_filled FROM documents)"""

_ENDS = f"regexp_matches({S.rstrip('content')}, '[.!?。…]$')"

# --- chunks and batches --------------------------------------------------------------------------


@query("chunks", "U1 F4")
def chunks(spark, sf):
    return B.chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 3000)


@query("request_batches", "U2", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, (n - 1) // 30 + 1 AS batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM r GROUP BY 1, 2""")
def request_batches(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    r = B.requests(d, ["source"], [F.col("doc_id")], B.BATCH["dedup"], F.col("doc_id").cast("string"))
    return r.select("source", "batch", F.array_join("payload", ",").alias("ids"))


_CAT = "CASE WHEN doc_id < 2 THEN 'tiny' WHEN doc_id < 300 AND doc_id % 9 = 0 THEN 'm' || (doc_id % 4) ELSE source END"


@query("category_routes", "U3", f"""
WITH a AS (SELECT doc_id, {_CAT} AS category FROM documents), g AS (SELECT category, count(*) AS n, min(doc_id) AS f FROM a GROUP BY 1),
r AS (SELECT doc_id, category, CASE WHEN n <= 2 THEN 'keep' WHEN n < 15 THEN 'combined' ELSE 'solo' END AS route, n, f FROM a JOIN g USING (category))
SELECT doc_id, category, route, CASE WHEN route <> 'keep' THEN (row_number() OVER (PARTITION BY route, CASE WHEN route = 'combined' THEN '' ELSE category END ORDER BY CASE WHEN route = 'combined' THEN f ELSE 0 END, doc_id) - 1) // 30 + 1 END AS batch FROM r""")
def category_routes(spark, sf):
    i = F.col("doc_id")
    cat = F.when(i < 2, "tiny").when((i < 300) & (i % 9 == 0), F.concat(F.lit("m"), (i % 4).cast("string"))).otherwise(F.col("source"))
    return B.route_categories(table(spark, sf, "documents").select("doc_id", cat.alias("category")), "category", "doc_id")


@query("stream_caps", "U4", """
WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'gap' ELSE 'code' END AS stream, doc_id AS ord FROM documents)
SELECT * FROM (SELECT * FROM d WHERE stream = 'gap' ORDER BY ord LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM d WHERE stream = 'code' ORDER BY ord LIMIT 15)""")
def stream_caps(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 2 == 0, "gap").otherwise("code").alias("stream"), F.col("doc_id").alias("ord"))
    gap = B.capped(d.filter("stream = 'gap'"), [F.col("ord")], "gap_atoms")
    return gap.unionByName(B.capped(d.filter("stream = 'code'"), [F.col("ord")], "code_atoms"))


# --- dedup ---------------------------------------------------------------------------------------

_KW = S.keyword_set("kw", "reps", "rep", "title || ' ' || content", K.STOP_DEDUP)
_NUMS = f"list_sort(list_distinct(regexp_extract_all(content, '{T.NUMBER}')))"
_THR = 0.6


_ISSUES = f"""reps AS (SELECT min(idx) AS rep, source, title, content, gap_filled FROM atoms WHERE source <> 'codebase' GROUP BY source, title, content, gap_filled), {_KW},
n AS (SELECT id, count(*) AS n FROM kw GROUP BY 1),
o AS (SELECT x.id AS t, y.id AS b, count(*)::DOUBLE AS c FROM kw x JOIN kw y USING (kw) JOIN reps rx ON rx.rep = x.id AND rx.source = 'transcript' JOIN reps ry ON ry.rep = y.id AND ry.source = 'baseline' GROUP BY 1, 2),
p AS (SELECT t, b, c / least(nt.n, nb.n) AS overlap FROM o JOIN n nt ON nt.id = t JOIN n nb ON nb.id = b),
f AS (SELECT rep, gap_filled, {_NUMS} AS nums, {S.any_of('lower(content)', K.NEGATIONS)} AS neg FROM reps),
i AS (SELECT t, b, overlap, CASE WHEN overlap >= {_THR}::DOUBLE THEN 'duplicate' WHEN overlap < {_THR * 2 / 3!r}::DOUBLE THEN NULL WHEN x.neg <> y.neg THEN 'contradiction'
  WHEN len(x.nums) > 0 AND len(y.nums) > 0 AND x.nums <> y.nums THEN CASE WHEN y.gap_filled THEN 'outdated' ELSE 'contradiction' END END AS issue FROM p JOIN f x ON x.rep = t JOIN f y ON y.rep = b)"""


@query("issue_pairs", "J7 K3", f"WITH {_ATOMS}, {_ISSUES} SELECT t, b, round(overlap, 6) AS overlap, issue FROM i WHERE issue IS NOT NULL")
def issue_pairs(spark, sf):
    reps = _atoms(spark, sf).filter("source <> 'codebase'").groupBy("source", "title", "content", "gap_filled").agg(F.min("idx").alias("rep"))
    t, b = (reps.filter(F.col("source") == s) for s in ("transcript", "baseline"))
    p = D.issue_pairs(t.withColumnRenamed("rep", "t"), b.withColumnRenamed("rep", "b"), "t", "b", "content", _THR, title="title")
    return p.withColumn("overlap", F.round("overlap", 6))


# One pair a step, in order: ``gone`` atoms take no part, a ``done`` one has had its turn.
_DECIDE = f"""m AS (SELECT a.idx, r.rep, a.confidence AS c FROM atoms a JOIN reps r USING (source, title, content, gap_filled)),
pr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t.idx, b.idx) AS k, t.idx AS t, b.idx AS b, issue, t.c >= b.c AS keep_t FROM i JOIN m t ON t.rep = i.t JOIN m b ON b.rep = i.b WHERE issue IS NOT NULL),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, []::BIGINT[] AS done, []::BIGINT[] AS seen UNION ALL
  SELECT x.k, CASE WHEN NOT x.live OR issue = 'contradiction' THEN gone WHEN issue = 'duplicate' AND keep_t THEN list_append(gone, b) ELSE list_append(gone, t) END,
   CASE WHEN x.live AND issue = 'duplicate' THEN list_append(done, t) ELSE done END, CASE WHEN x.live AND issue = 'contradiction' THEN list_append(seen, x.k) ELSE seen END
  FROM (SELECT pr.*, gone, done, seen, NOT (list_contains(gone, t) OR list_contains(gone, b) OR list_contains(done, t)) AS live FROM s JOIN pr ON pr.k = s.k + 1) x),
fin AS (SELECT gone, seen FROM s ORDER BY k DESC LIMIT 1), hit AS (SELECT k, t, b FROM (SELECT unnest(seen) AS k FROM fin) JOIN pr USING (k)),
conf AS (SELECT idx, max(k) AS k FROM (SELECT t AS idx, k FROM hit UNION ALL SELECT b, k FROM hit) GROUP BY 1)"""


@query("cross_source_dedup", "J8 X3 F4", f"""WITH RECURSIVE {_ATOMS}, {_ISSUES}, {_DECIDE}
SELECT a.idx, a.source, CASE WHEN pr.k IS NOT NULL THEN 'contradiction' END AS conflict_type, pr.t AS conflict_t, pr.b AS conflict_b
FROM atoms a LEFT JOIN conf ON conf.idx = a.idx LEFT JOIN pr ON pr.k = conf.k WHERE NOT list_contains((SELECT gone FROM fin), a.idx)""")
def cross_source_dedup(spark, sf):
    a = _atoms(spark, sf).select("idx", "title", F.col("content").alias("text"), "source", "confidence", "gap_filled")
    out = D.cross_source_dedup(a, _THR)["atoms"]
    return out.select("idx", "source", "conflict_type", F.col("conflict_pair.t_idx").alias("conflict_t"), F.col("conflict_pair.b_idx").alias("conflict_b"))


@query("remove_by_id", "X3", f"WITH {_ATOMS} SELECT idx, category FROM atoms WHERE idx NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_by_id(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("idx"))
    return D.remove_ids(_atoms(spark, sf).select("idx", "category"), gone, "idx")


@query("adaptive_threshold", "A25", """
SELECT lang, source, count(*) AS n, greatest(CASE WHEN count(*) < 30 THEN 0.8 - 0.15::DOUBLE WHEN count(*) < 50 THEN 0.8 - 0.10::DOUBLE WHEN count(*) < 100 THEN 0.8 - 0.05::DOUBLE ELSE 0.8 END, 0.5) AS threshold FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def adaptive_threshold(spark, sf):
    d = table(spark, sf, "documents")
    n = d.groupBy("lang", "source").agg(F.count("*").alias("n")).unionByName(
        d.groupBy("lang").agg(F.count("*").alias("n")).withColumn("source", F.lit(None).cast("string")))
    return n.withColumn("threshold", D.adaptive_threshold(0.8, F.col("n")))


# One atom a step, in order: it takes the first later unused similar atom of each other source.
_CLUSTERS = f"""src AS (SELECT doc_id, source, {_TEXT200} AS t FROM documents), {tfidf_sql('src', 'doc_id', 't')}, reps AS (SELECT min(doc_id) AS rep, t FROM src GROUP BY t),
near AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.term = y.term WHERE x.id <> y.id AND x.id IN (SELECT rep FROM reps) AND y.id IN (SELECT rep FROM reps) GROUP BY 1, 2 HAVING least(1, sum(x.w * y.w)) > 0.80
  UNION ALL SELECT rep, rep FROM reps), m AS (SELECT doc_id, source, rep FROM src JOIN reps USING (t)),
c AS MATERIALIZED (SELECT x.doc_id AS i, list({{'j': y.doc_id, 's': y.source}} ORDER BY y.doc_id) AS js, row_number() OVER (ORDER BY x.doc_id) AS k
  FROM m x JOIN near ON near.a = x.rep JOIN m y ON y.rep = near.b AND y.doc_id > x.doc_id AND y.source <> x.source GROUP BY 1),
s AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS head, 0::BIGINT AS n UNION ALL
  SELECT k, list_concat(used, list_transform(got, lambda x: x.j)), i, CASE WHEN len(got) > 0 THEN 1 + len(got) ELSE 0 END
  FROM (SELECT k, used, i, list_filter(open, lambda x, place: list_position(list_transform(open, lambda y: y.s), x.s) = place) AS got
    FROM (SELECT c.k, used, i, list_filter(js, lambda x: NOT list_contains(used, x.j) AND NOT list_contains(used, i)) AS open FROM s JOIN c ON c.k = s.k + 1)))"""


@query("corroboration", "J11 F4", f"""WITH RECURSIVE {_CLUSTERS}
SELECT head, n AS n_sources, printf('Corroborated by %d sources.', n) AS note FROM s WHERE n >= 2""")
def corroboration(spark, sf):
    d = _texts(spark, sf)
    pairs = Z.self_pairs(d, "doc_id", "t", 0.80).filter(F.col("sim") > 0.80)
    ids = Z.distinct_texts(d, "doc_id", "t").select("t", F.col("doc_id").alias("text_id"))
    atoms = d.join(ids, "t").select(F.col("doc_id").alias("idx"), "source", "text_id")
    return D.corroborate(atoms, pairs).withColumn("note", F.format_string("Corroborated by %d sources.", "n_sources"))


def _conflicts(spark, sf):
    i = F.col("event_id")
    c = table(spark, sf, "events").select(
        i.alias("ord"), F.format_string("atom_%04d", F.col("user_id") * 7).alias("a_id"), F.format_string("atom_%04d", i % 1200).alias("b_id"),
        F.when(F.col("event_type") == "view", "Duplicate_content").when(F.col("event_type") == "click", "overlapping_scope").when(F.col("event_type") == "signup", "minor_variation").alias("conflict_type"),
        F.when(i % 2 == 0, F.col("props")).alias("description"), (F.col("value") > 60).alias("claim_verified"), (F.col("value") / 100).alias("claim_confidence"))
    return X.materialise_conflicts(c, _atoms(spark, sf).select("id", "title", "content", "source"), "ord")


_CONFLICTS = f"""{_ATOMS}, c0 AS (SELECT event_id AS ord, printf('atom_%04d', user_id * 7) AS a_id, printf('atom_%04d', event_id % 1200) AS b_id,
 CASE event_type WHEN 'view' THEN 'Duplicate_content' WHEN 'click' THEN 'overlapping_scope' WHEN 'signup' THEN 'minor_variation' END AS conflict_type,
 CASE WHEN event_id % 2 = 0 THEN props END AS description, value > 60 AS claim_verified, value / 100 AS claim_confidence FROM events),
c AS (SELECT printf('conflict_%03d', row_number() OVER (ORDER BY ord)) AS conflict_id, a_id, b_id, coalesce(conflict_type, 'contradictory_data') AS conflict_type, coalesce(description, '') AS description,
 coalesce(x.title, 'Unknown') AS a_title, coalesce(x.content, '') AS a_content, x.source AS a_source, coalesce(y.title, 'Unknown') AS b_title, coalesce(y.content, '') AS b_content, y.source AS b_source, claim_verified, claim_confidence
 FROM c0 LEFT JOIN atoms x ON x.id = a_id LEFT JOIN atoms y ON y.id = b_id),
r AS (SELECT *, CASE WHEN claim_verified AND claim_confidence > 0.8 THEN 'keep_a' WHEN regexp_matches(lower(conflict_type), 'duplicate|minor_variation|overlap') AND a_content <> '' AND b_content <> ''
 THEN CASE WHEN length(a_content) >= length(b_content) THEN 'keep_a' ELSE 'keep_b' END ELSE 'pending' END AS resolution FROM c)"""


@query("conflict_rows", "J15", f"WITH {_CONFLICTS} SELECT conflict_id, a_id, b_id, conflict_type, description, a_title, b_title, length(a_content) AS a_length, length(b_content) AS b_length FROM c")
def conflict_rows(spark, sf):
    return _conflicts(spark, sf).select("conflict_id", "a_id", "b_id", "conflict_type", "description", "a_title", "b_title",
                                        "a_length", "b_length")


@query("conflict_resolution", "J16", f"WITH {_CONFLICTS} SELECT conflict_id, resolution, resolution <> 'pending' AS auto_resolved FROM r")
def conflict_resolution(spark, sf):
    return X.auto_resolve(_conflicts(spark, sf)).select("conflict_id", "resolution", "auto_resolved")


@query("conflict_rejects", "J16 X3", f"WITH {_CONFLICTS} SELECT id FROM atoms WHERE id NOT IN (SELECT CASE WHEN resolution = 'keep_a' THEN b_id ELSE a_id END FROM r WHERE resolution <> 'pending')")
def conflict_rejects(spark, sf):
    return D.remove_ids(_atoms(spark, sf).select("id"), X.rejected(X.auto_resolve(_conflicts(spark, sf))), "id")


@query("review_view", "J21", f"""WITH {_CONFLICTS} SELECT conflict_id, coalesce(nullif(a_content, ''), a_title) AS atom_a, coalesce(nullif(b_content, ''), b_title) AS atom_b,
 coalesce(a_source, 'transcript') AS source_a, coalesce(b_source, 'baseline') AS source_b, conflict_type, description FROM r WHERE resolution = 'pending'""")
def review_view(spark, sf):
    return X.review_view(X.auto_resolve(_conflicts(spark, sf)), _atoms(spark, sf))


@query("dedup_answers", "J17", f"""
WITH {_ATOMS}, b AS (SELECT build AS batch, id, content, category, source, idx FROM atoms),
a AS (SELECT build AS batch, id, CASE WHEN idx % 4 = 0 THEN content || ' and more' ELSE 'short' END AS new, CASE WHEN idx % 2 = 0 THEN 'atom_x' END AS mf FROM atoms WHERE CASE WHEN build IN ('src1', 'src2') THEN idx % 5 = 0 ELSE idx % 3 > 0 END
   UNION ALL SELECT DISTINCT build, 'new_' || build, 'made up', NULL FROM atoms),
n AS (SELECT batch, count(*) AS n FROM b GROUP BY 1), k AS (SELECT batch, count(*) AS k FROM a GROUP BY 1), ok AS (SELECT n.batch, coalesce(k, 0) >= greatest(1, n * 0.3) AS ok FROM n LEFT JOIN k USING (batch))
SELECT b.batch, b.id, CASE WHEN ok AND mf IS NOT NULL AND length(new) > length(content) THEN new ELSE content END AS content, category, source, CASE WHEN ok THEN mf END AS merged_from FROM b JOIN ok USING (batch) LEFT JOIN a USING (batch, id) WHERE NOT ok OR a.id IS NOT NULL
UNION ALL SELECT a.batch, a.id, new, 'general', 'transcript', mf FROM a JOIN ok USING (batch) WHERE ok AND starts_with(a.id, 'new_')""")
def dedup_answers(spark, sf):
    a = _atoms(spark, sf)
    picked = F.when(F.col("build").isin("src1", "src2"), F.col("idx") % 5 == 0).otherwise(F.col("idx") % 3 > 0)
    answers = a.filter(picked).select(
        F.col("build").alias("batch"), "id", F.when(F.col("idx") % 4 == 0, F.concat("content", F.lit(" and more"))).otherwise("short").alias("content"),
        F.when(F.col("idx") % 2 == 0, F.array(F.lit("atom_x"))).alias("merged_from"))
    new = a.select(F.col("build").alias("batch")).distinct().select(
        "batch", F.concat(F.lit("new_"), "batch").alias("id"), F.lit("made up").alias("content"), F.lit(None).cast("array<string>").alias("merged_from"))
    out = X.merge_answers(a.select(F.col("build").alias("batch"), "id", "content", "category", "source"), answers.unionByName(new))
    return out.select("batch", "id", "content", "category", "source", F.array_join("merged_from", ",").alias("merged_from"))


@query("review_decisions", "J20", f"""
WITH {_ATOMS}, d AS (SELECT event_id AS ord, CASE event_type WHEN 'view' THEN 'keep_a' WHEN 'click' THEN 'keep_b' WHEN 'signup' THEN 'merge' WHEN 'purchase' THEN 'discard' END AS action,
  printf('atom_%04d', event_id * 3) AS a_id, printf('atom_%04d', event_id * 3 + 1) AS b_id, CASE WHEN event_id % 3 > 0 THEN props ELSE '' END AS mc FROM events),
x AS (SELECT *, coalesce(action, 'keep_a') AS act, coalesce(action, 'keep_a') = 'merge' AND mc <> '' AS m FROM d),
dr AS (SELECT b_id AS id FROM x WHERE act IN ('keep_a', 'discard') OR m UNION SELECT a_id FROM x WHERE act IN ('keep_b', 'discard')),
mm AS (SELECT a_id AS id, arg_max(mc, ord) AS mc FROM x WHERE m GROUP BY 1)
SELECT atoms.id, coalesce(mc, content) AS content, CASE WHEN mc IS NOT NULL THEN 'deduplicated' ELSE status END AS status FROM atoms LEFT JOIN mm USING (id) WHERE atoms.id NOT IN (SELECT id FROM dr)""")
def review_decisions(spark, sf):
    i = F.col("event_id")
    act = F.create_map(*[F.lit(v) for v in ("view", "keep_a", "click", "keep_b", "signup", "merge", "purchase", "discard")])
    d = table(spark, sf, "events").select(
        i.alias("ord"), act[F.col("event_type")].alias("action"), F.format_string("atom_%04d", i * 3).alias("a_id"),
        F.format_string("atom_%04d", i * 3 + 1).alias("b_id"), F.when(i % 3 > 0, F.col("props")).otherwise("").alias("merged_content"))
    return X.apply_decisions(_atoms(spark, sf).select("id", "content", "status"), d)


# --- verification --------------------------------------------------------------------------------


@query("verify_sample", "W8", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS n, count(*) OVER () AS c FROM documents) SELECT doc_id FROM r WHERE n <= greatest(1, floor(c * 70 / 100))""")
def verify_sample(spark, sf):
    return E.sample_for_tier(table(spark, sf, "documents").select("doc_id"), "doc_id", "standard")


@query("passthrough", "X4", f"""
WITH {_ATOMS}, r AS (SELECT idx, row_number() OVER (ORDER BY md5(CAST(idx AS VARCHAR) || '|42'), idx) AS n, count(*) OVER () AS c FROM atoms), s AS (SELECT idx FROM r WHERE n <= greatest(1, floor(c * 30 / 100)))
SELECT idx, CASE WHEN idx IN (SELECT idx FROM s) THEN status ELSE 'passthrough' END AS status, CASE WHEN idx IN (SELECT idx FROM s) THEN baseline_reference ELSE coalesce(baseline_reference, 'Not sampled — passed through') END AS note FROM atoms""")
def passthrough(spark, sf):
    a = _atoms(spark, sf).select("idx", "status", F.col("baseline_reference").alias("verification_note"))
    return E.mark_passthrough(a, E.sample_for_tier(a, "idx", "draft"), "idx").withColumnRenamed("verification_note", "note")


_VERDICTS = f"""{_ATOMS}, v AS (SELECT doc_id AS idx, CASE WHEN toxic = 1 THEN 'flagged' WHEN doc_id % 5 > 0 THEN 'verified' END AS st, 0.1::DOUBLE * quality AS adj FROM labels),
o AS (SELECT a.idx, build = 'src3' AS failed, v.idx IS NOT NULL AND build <> 'src3' AS has, v.st, v.adj, a.confidence FROM atoms a LEFT JOIN v USING (idx)),
d AS (SELECT idx, CASE WHEN has THEN coalesce(st, 'verified') ELSE 'unverified' END AS status, round(CASE WHEN has THEN least(1.0, confidence + adj) ELSE confidence END, 6) AS confidence,
  CASE WHEN has THEN 'checked' WHEN failed THEN 'Verification skipped: batch failed' ELSE 'Expert insight — batch verify fallback' END AS verification_note, NOT has AS is_fallback FROM o)"""


def _verdicts(spark, sf):
    v = table(spark, sf, "labels").select(
        F.col("doc_id").alias("idx"), F.when(F.col("toxic") == 1, "flagged").when(F.col("doc_id") % 5 > 0, "verified").alias("status"),
        (F.lit(0.1) * F.col("quality")).alias("confidence_adjustment"), F.lit("checked").alias("verification_note"), F.lit(None).cast("string").alias("baseline_reference"))
    a = _atoms(spark, sf).select("idx", "build", "confidence")
    return E.apply_verdicts(a, v, "idx", F.col("build") == "src3")


@query("verdict_join", "J18", f"WITH {_VERDICTS} SELECT * FROM d")
def verdict_join(spark, sf):
    return _verdicts(spark, sf).select("idx", "status", F.round("confidence", 6).alias("confidence"), "verification_note", "is_fallback")


@query("verdict_counters", "J18", f"WITH {_VERDICTS} SELECT count(*) FILTER (status <> 'flagged') AS verified_count, count(*) FILTER (status = 'flagged') AS flagged_count, count(*) FILTER (is_fallback) AS fallback_count FROM d")
def verdict_counters(spark, sf):
    return E.verdict_counters(_verdicts(spark, sf))


@query("stratified_holdout", "W9", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS n, count(*) OVER (PARTITION BY quality) AS c FROM labels)
SELECT doc_id, quality, CASE WHEN n <= greatest(1, floor(c * 0.4)) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_holdout(spark, sf):
    return E.stratified_holdout(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


# --- scorecards ----------------------------------------------------------------------------------


def _refs_by_source(spark, sf):
    return table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("content"))


def _first_topics(spark, sf):
    """First ten document titles per source as its topics."""
    t = top_rows(table(spark, sf, "documents").select("source", "doc_id", F.regexp_extract("text", "^[^.\\n]*", 0).alias("t")), ["source"], [F.col("doc_id")], 10)
    return t.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]).alias("topics"))


_TOPICS10 = "t10 AS (SELECT source, regexp_extract(text, '^[^.\\n]*') AS t FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10)"


def _planned(words):
    """A baseline that has no references yet, beside each run's own."""
    return words.select(F.lit("planned").alias("source"), F.array().cast("array<string>").alias("words")).limit(1)


def _hits_sql(words: str) -> str:
    return f"""h AS (SELECT d.source, d.doc_id, coalesce(sum(CASE WHEN contains(lower(d.text), w.w) THEN 1 ELSE 0 END), 0) AS hits, count(w.w) AS nw FROM documents d LEFT JOIN {words} w ON w.source = d.source GROUP BY 1, 2)"""


@query("baseline_quality", "A5", f"""
WITH {_TOPICS10}, w0 AS (SELECT source, unnest({S.tokens('source')}) AS w FROM documents UNION SELECT source, unnest({S.tokens('t')}) FROM t10), dw AS (SELECT DISTINCT source, w FROM w0 WHERE w NOT IN {S.in_list(K.GENERIC_BASELINE)}),
{_hits_sql('dw')}, {S.keywords('kw', 'documents', 'doc_id', 'text', 20, (), 4, 30)},
n AS (SELECT id, count(*) AS n FROM kw GROUP BY 1), s AS (SELECT n.id, n.n, d.source FROM n JOIN documents d ON d.doc_id = n.id),
o AS (SELECT x.id AS a, y.id AS b, count(*)::DOUBLE AS c FROM kw x JOIN kw y ON x.kw = y.kw AND x.id < y.id JOIN s sx ON sx.id = x.id JOIN s sy ON sy.id = y.id AND sx.source = sy.source GROUP BY 1, 2),
p AS (SELECT sx.source, sum(c / least(sx.n, sy.n)) AS overlap FROM o JOIN s sx ON sx.id = a JOIN s sy ON sy.id = b GROUP BY 1), f AS (SELECT source, count(*) AS f FROM s GROUP BY 1),
g AS (SELECT source, count(*) AS n, avg(CASE WHEN w BETWEEN 200 AND 5000 THEN 1.0 WHEN w BETWEEN 50 AND 199 THEN 0.5 WHEN w > 5000 THEN 0.7 ELSE 0.1 END::DOUBLE) AS depth FROM (SELECT source, {S.words('text')} AS w FROM documents) GROUP BY 1),
rel AS (SELECT source, avg(CASE WHEN hits >= 2 THEN 1.0 ELSE 0 END::DOUBLE) AS rel, max(nw) AS nw FROM h GROUP BY 1)
SELECT g.source, round(least(100, greatest(0, depth * 40 + CASE WHEN g.n >= 2 THEN (1 - coalesce(overlap, 0) / greatest(f * (f - 1) / 2.0, 1)) * 100 ELSE 0 END * 0.3 + CASE WHEN nw > 0 THEN rel * 100 ELSE 50 END * 0.3)), 6) AS score
FROM g LEFT JOIN p USING (source) LEFT JOIN f USING (source) LEFT JOIN rel USING (source) UNION ALL SELECT 'planned', 30""")
def baseline_quality(spark, sf):
    words = _first_topics(spark, sf).select("source", R.domain_words(F.col("source"), F.col("topics")).alias("words"))
    return R.baseline_quality(_refs_by_source(spark, sf), "source", "content", words.unionByName(_planned(words))).withColumn("score", F.round("score", 6))


@query("reference_quality", "A6", f"""
WITH {_TOPICS10}, dw AS (SELECT DISTINCT source, w FROM (SELECT source, unnest({S.tokens('t', 4)}) AS w FROM t10) WHERE w NOT IN {S.in_list(K.GENERIC_TOPIC)}), {_hits_sql('dw')},
g AS (SELECT source, count(*) AS n, avg(CASE WHEN {S.words('text')} >= 200 THEN 1.0 ELSE 0 END::DOUBLE) AS deep FROM documents GROUP BY 1), rel AS (SELECT source, avg(CASE WHEN hits >= 2 THEN 1.0 ELSE 0 END::DOUBLE) AS rel, max(nw) AS nw FROM h GROUP BY 1)
SELECT g.source, n, round(least(95, greatest(20, deep * 45 + CASE WHEN nw > 0 THEN rel * 100 ELSE 50 END * 0.45 + least(15, n * 1.5))), 6) AS score FROM g JOIN rel USING (source) UNION ALL SELECT 'planned', 0, 30""")
def reference_quality(spark, sf):
    words = _first_topics(spark, sf).select("source", R.topic_words(F.col("topics")).alias("words"))
    return R.reference_quality(_refs_by_source(spark, sf), "source", "content", words.unionByName(_planned(words))).withColumn("score", F.round("score", 6))


_CUT_REF = f"CASE WHEN length(text) > 30000 THEN left(text, 30000) || {S.NL} || {S.NL} || '*[Truncated]*' ELSE text END"


@query("baseline_references", "A26", f"""
WITH p AS (SELECT page_id, url, html AS text FROM pages)
SELECT page_id, printf('ref_%03d_', page_id + 1) || split_part(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), '.', 1) || '.md' AS name,
 {_CUT_REF} AS content, length({_CUT_REF}) // 4 AS tokens FROM p""")
def baseline_references(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("text"))
    return C.baseline_references(p, "page_id", "url", "text").select("page_id", "name", F.col("text").alias("content"), "tokens")


@query("baseline_summary", "A26", f"""
WITH d AS (SELECT source, doc_id, length(text) > 30000 AS cut, {_CUT_REF} AS text, {S.words('text')} >= 200 AS ok FROM documents)
SELECT source, count(*) AS refs, sum(length(text) // 4)::BIGINT AS total_tokens, CAST(trunc(sum({S.words('text')} * 1.3::DOUBLE)) AS BIGINT) AS word_tokens,
 count(*) FILTER (ok) AS crawled_ok, count(*) FILTER (NOT ok) AS crawled_fail, sum(cut)::BIGINT AS truncated, min(printf('ref_%03d_', doc_id + 1) || source || '.md') AS first_name FROM d GROUP BY 1""")
def baseline_summary(spark, sf):
    d = table(spark, sf, "documents").withColumn("w", T.word_count(F.col("text")))
    return C.baseline_summary(d, "source", "doc_id", "text", F.col("w") >= 200)


_DEPTHS = ["deep", "moderate", "surface", "mention_only", "other"]


@query("inventory_score", "A7", f"""
WITH t AS (SELECT source, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE lang || (doc_id % 2) END AS category, ([{', '.join(S.q(d) for d in _DEPTHS)}])[doc_id * doc_id % 5 + 1] AS depth FROM documents),
a AS (SELECT source, count(*) AS n, avg((depth = 'deep')::INT) AS deep, avg((depth = 'moderate')::INT) AS moderate, avg((depth = 'mention_only')::INT) AS mention, count(DISTINCT nullif(trim(category), '')) AS cats FROM t GROUP BY 1),
k AS (SELECT source, 1 + min(doc_id) % 9 AS tr, CASE WHEN min(doc_id) % 4 > 0 THEN count(*) FILTER (doc_id % 3 = 0) END AS gap, count(*) FILTER (doc_id % 3 = 1) AS ov, count(*) FILTER (doc_id % 3 = 2) AS un, count(*)::DOUBLE AS tot FROM documents GROUP BY 1),
x AS (SELECT a.*, n::DOUBLE / tr AS per, gap / tot AS g, ov / tot AS o, un / tot AS u FROM a JOIN k USING (source)),
y AS (SELECT source, CASE WHEN per BETWEEN 8 AND 25 THEN 100 WHEN per < 8 THEN greatest(40, per / 8 * 100) ELSE greatest(CASE WHEN n > 100 THEN 85 ELSE 70 END, 100 - (per - 25) * 2) END AS density,
  least(100, least(deep, 0.4) / 0.4 * 40 + least(moderate, 0.4) / 0.4 * 35 + (1 - least(mention, 0.3)) / 0.7 * 25) AS mix, CASE WHEN cats >= 5 THEN 100 WHEN cats >= 3 THEN 80 WHEN cats = 2 THEN 60 WHEN cats = 1 THEN 40 ELSE 20 END AS cat,
  CASE WHEN g IS NULL THEN 50 ELSE (CASE WHEN o BETWEEN 0.15 AND 0.85 THEN 35 ELSE greatest(0, 35 - abs(o - 0.5) * 50) END + CASE WHEN u BETWEEN 0.05 AND 0.6 THEN 35 ELSE greatest(0, 35 - abs(u - 0.3) * 70) END
   + CASE WHEN g <= 0.35 THEN 30 ELSE greatest(0, 30 - abs(g - 0.15) * 60) END) * CASE WHEN g > 0.5 THEN 0.5 ELSE 1 END END AS bal FROM x)
SELECT source, round(least(100, greatest(0, density * 0.3 + mix * 0.25 + cat * 0.2 + bal * 0.25)), 6) AS score FROM y""")
def inventory_score(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    topics = d.select("source", F.when(i % 13 == 0, " ").otherwise(F.concat("lang", (i % 2).cast("string"))).alias("category"),
                      F.element_at(F.array(*[F.lit(x) for x in _DEPTHS]), (i * i % 5 + 1).cast("int")).alias("depth"))
    transcripts = d.groupBy("source").agg((1 + F.min("doc_id") % 9).alias("transcripts"))

    def n(k):
        return F.count(F.when(i % 3 == k, 1))

    cover = d.groupBy("source").agg(n(0).alias("gap_count"), n(1).alias("overlap_count"), n(2).alias("unique_expert_count"), F.count("*").alias("total"),
                                    F.min("doc_id").alias("m")).filter("m % 4 > 0").drop("m")
    return R.inventory(topics, "source", transcripts, cover).withColumn("score", F.round("score", 6))


@query("extraction_score", "A8 K14", f"""
WITH {_ATOMS}, a AS (SELECT build, count(*) AS n, sum((length(content) BETWEEN 100 AND 2000)::INT + {_ENDS}::INT + 1 + (len(tags) >= 2)::INT + ({S.words('title')} >= 3)::INT) AS p, avg(confidence) AS c, bool_or(source = 'transcript') AS t, bool_or(gap_filled) AS g,
  1 + min(idx) % 11 AS ch FROM atoms GROUP BY 1), x AS (SELECT *, n::DOUBLE / ch AS per FROM a)
SELECT build, round(least(100, p::DOUBLE / (n * 5) * 60 + CASE WHEN per BETWEEN 8 AND 15 THEN 100 WHEN per < 8 THEN greatest(50, per / 8 * 100) ELSE greatest(70, 100 - (per - 15) * 3) END * 0.4 + CASE WHEN t AND g THEN 5 ELSE 0 END), 6) AS score, round_even(c, 3) AS avg_confidence FROM x""")
def extraction_score(spark, sf):
    a = _atoms(spark, sf)
    chunks_ = a.groupBy("build").agg((1 + F.min("idx") % 11).alias("chunks"))
    return R.extraction(a, "build", chunks_).withColumn("score", F.round("score", 6))


@query("dedup_score", "A9", f"""
WITH {_ATOMS}, k AS (SELECT build, count(*) AS kept, sum(CASE WHEN length(content) > 20 AND NOT {_ENDS} THEN 2 ELSE 0 END + CASE WHEN idx % 40 = 0 THEN 3 ELSE 0 END) AS pen FROM atoms WHERE idx % (2 + length(build)) > 0 GROUP BY 1),
n AS (SELECT build, count(*) AS n, count(*) FILTER (idx % 17 = 0) AS dup FROM atoms GROUP BY 1), x AS (SELECT *, kept::DOUBLE / n AS r, CASE WHEN n < 30 THEN 0.7 WHEN n < 100 THEN 0.5 ELSE 0.4 END AS lo, CASE WHEN n < 30 THEN 0.95 WHEN n < 100 THEN 0.85 ELSE 0.75 END AS hi FROM n JOIN k USING (build))
SELECT build, round(greatest(0, least(100, CASE WHEN r BETWEEN lo AND hi THEN 90 WHEN r > hi THEN 90 - (r - hi) / (1 - hi) * 25 ELSE 90 - (lo - r) / lo * 40 END + least(10, dup * 2) - least(20, pen))), 6) AS score FROM x""")
def dedup_score(spark, sf):
    a = _atoms(spark, sf)
    kept = a.filter(F.col("idx") % (2 + F.length("build")) > 0).withColumn("category", F.when(F.col("idx") % 40 == 0, " ").otherwise(F.col("category")))
    counts = a.groupBy("build").agg(F.count("*").alias("n"), F.count(F.when(F.col("idx") % 17 == 0, 1)).alias("duplicates"))
    return R.dedup(counts, kept, "build").withColumn("score", F.round("score", 6))


_PH = "max(CASE WHEN l_linenumber = {} THEN l_extendedprice % 100 END)"


@query("build_score", "A11", f"""
WITH p AS (SELECT l_orderkey AS k, {', '.join(f"coalesce({_PH.format(i + 1)}, 0) AS {p}" for i, p in enumerate(K.PHASE_WEIGHTS))} FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, o_custkey % 30 AS atoms, o_orderkey % 40 AS pages FROM orders),
s AS (SELECT b.k, atoms, pages, coalesce(p0, 0) AS p0, coalesce(p4, 0) AS p4, least(100, greatest(0, {' + '.join(f"coalesce({p}, 0) * {w}" for p, w in K.PHASE_WEIGHTS.items())})) AS t FROM b LEFT JOIN p USING (k)),
c AS (SELECT *, CASE WHEN p0 < 50 THEN least(t, 60) ELSE t END AS t1 FROM s), d AS (SELECT *, CASE WHEN p4 < 30 THEN t1 * 0.8 ELSE t1 END AS t2 FROM c)
SELECT k, round(CASE WHEN atoms < 10 AND pages > 20 THEN greatest(0, t2 - 20) ELSE t2 END, 6) AS score FROM d""")
def build_score(spark, sf):
    phases = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.concat(F.lit("p"), (F.col("l_linenumber") - 1).cast("string")).alias("phase"), (F.col("l_extendedprice") % 100).alias("score"))
    builds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 30).alias("atoms"), (F.col("o_orderkey") % 40).alias("input_pages"))
    return R.weighted_build(phases, builds, "k").withColumn("score", F.round("score", 6))


@query("presence_score", "A11", """
SELECT o_orderkey AS k, ((o_totalprice > 100000)::INT + (o_custkey % 3 > 0)::INT + (coalesce(l.n, 0) > 1)::INT + (o_orderstatus = 'F')::INT + (coalesce(l.n, 0) > 0)::INT) / 5.0 * 100 AS score
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def presence_score(spark, sf):
    """Five checks of a published build: document, pillars, every pillar's file, package, atoms."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(n, "o_orderkey", "left")
    atoms = F.coalesce("n", F.lit(0))
    checks = [F.col("o_totalprice") > 100000, F.col("o_custkey") % 3 > 0, atoms > 1, F.col("o_orderstatus") == "F", atoms > 0]
    return o.select(F.col("o_orderkey").alias("k"), R.presence(checks).alias("score"))


@query("compression_ratio", "A12", f"""
SELECT source, sum({S.words('text')}) FILTER (doc_id % 3 = 0)::BIGINT AS output_words, sum({S.words('text')})::BIGINT AS input_words, round(sum({S.words('text')}) FILTER (doc_id % 3 = 0)::DOUBLE / greatest(sum({S.words('text')}), 1), 6) AS ratio FROM documents GROUP BY 1""")
def compression_ratio(spark, sf):
    d = table(spark, sf, "documents")
    return R.compression(d.filter("doc_id % 3 = 0"), d, "source", "text", "text").withColumn("ratio", F.round("ratio", 6))


@query("smoke_test_score", "A13", """
WITH r AS (SELECT user_id, least(1, value / 120) AS s, CASE event_type WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.4 WHEN 'error' THEN 0.3 WHEN 'signup' THEN 0.33 ELSE 0.4 END::DOUBLE AS w FROM events)
SELECT user_id, count(*) FILTER (s >= 0.6) AS pass_count, count(*) AS total, round(sum(s * w) / sum(w), 6) AS score, sum(s * w) / sum(w) >= 0.6 AS passed FROM r GROUP BY 1""")
def smoke_test_score(spark, sf):
    tier = F.create_map(*[F.lit(v) for v in ("view", "basic", "click", "applied", "error", "advanced", "signup", "odd")])
    r = table(spark, sf, "events").select("user_id", F.least(F.lit(1.0), F.col("value") / 120).alias("score"), tier[F.col("event_type")].alias("tier"))
    return R.smoke_test(r, "user_id").withColumn("score", F.round("score", 6))


_TRIG = "t AS (SELECT doc_id, doc_id % 3 AS k, doc_id % 7 AS iteration, CASE WHEN doc_id % 5 < 2 THEN 'test' ELSE 'train' END AS split, quality = 1 AS s, (doc_id % 11 < 6) AND toxic = 0 AS t FROM labels)"


def _triggers(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "labels").select(
        "doc_id", (i % 3).alias("k"), (i % 7).alias("iteration"), F.when(i % 5 < 2, "test").otherwise("train").alias("split"),
        (F.col("quality") == 1).alias("should_trigger"), ((i % 11 < 6) & (F.col("toxic") == 0)).alias("triggered"))


@query("trigger_accuracy", "A14", f"WITH {_TRIG} SELECT k, iteration, split, round(avg((s = t)::INT), 6) AS accuracy, count(*) AS n FROM t GROUP BY 1, 2, 3")
def trigger_accuracy(spark, sf):
    return R.trigger_accuracy(_triggers(spark, sf), ["k", "iteration", "split"]).withColumn("accuracy", F.round("accuracy", 6))


@query("trigger_errors", "A14", f"WITH {_TRIG} SELECT doc_id, CASE WHEN s THEN 'MISSED' ELSE 'FALSE TRIGGER' END AS error FROM t WHERE s <> t")
def trigger_errors(spark, sf):
    return R.trigger_errors(_triggers(spark, sf)).select("doc_id", "error")


@query("best_iteration", "A14", f"""WITH {_TRIG}, a AS (SELECT k, iteration, coalesce(avg((s = t)::INT) FILTER (split = 'test'), 0) AS te, coalesce(avg((s = t)::INT) FILTER (split = 'train'), 0) AS tr FROM t GROUP BY 1, 2)
SELECT k, iteration, round(te, 6) AS test, round(tr, 6) AS train FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY te DESC, tr DESC, iteration) AS r FROM a WHERE te > 0 OR tr > 0) WHERE r = 1""")
def best_iteration(spark, sf):
    acc = R.trigger_accuracy(_triggers(spark, sf), ["k", "iteration", "split"])
    b = R.best_iteration(acc, "k")
    return b.withColumns({c: F.round(c, 6) for c in ("test", "train")})


@query("final_score", "A15", """
WITH s AS (SELECT o_orderkey, (o_orderkey * 7 % 101)::DOUBLE AS p, (o_custkey * 13 % 101)::DOUBLE AS m, (o_orderkey * 3 % 101)::DOUBLE AS t FROM orders),
f AS (SELECT *, least(100, greatest(0, round_even(p * 0.6::DOUBLE + m * 0.3::DOUBLE + t * 0.1::DOUBLE, 1))) AS score FROM s)
SELECT o_orderkey, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN score >= 80 THEN 'Production-ready' WHEN score >= 65 THEN 'Usable — minor improvements possible' WHEN score >= 50 THEN 'Usable with caveats — consider rebuilding' WHEN score >= 35 THEN 'Below standard — rebuild recommended' ELSE 'Not usable — needs significant rework' END AS verdict,
 concat_ws('; ', CASE WHEN p >= 80 THEN printf('Strong pipeline quality (%d/100)', p::INT) END, CASE WHEN m >= 70 THEN printf('Good smoke test results (%d%%)', m::INT) END, CASE WHEN t >= 80 THEN printf('Excellent trigger accuracy (%d%%)', t::INT) END) AS strengths,
 concat_ws('; ', CASE WHEN p < 60 THEN printf('Low pipeline quality (%d/100)', p::INT) END, CASE WHEN m > 0 AND m < 50 THEN printf('Low smoke test (%d%%) — skill may answer incorrectly', m::INT) WHEN m = 0 THEN 'No smoke test results — quality unverified' END,
  CASE WHEN t > 0 AND t < 60 THEN printf('Low trigger accuracy (%d%%) — skill may not activate', t::INT) END) AS weaknesses FROM f""")
def final_score(spark, sf):
    o = table(spark, sf, "orders")

    def of(col, k):
        return (F.col(col) * k % 101).cast("double")

    s = o.select("o_orderkey", R.final_score(of("o_orderkey", 7), of("o_custkey", 13), of("o_orderkey", 3)).alias("f"))
    return s.select("o_orderkey", "f.score", "f.grade", "f.verdict", F.array_join("f.strengths", "; ").alias("strengths"), F.array_join("f.weaknesses", "; ").alias("weaknesses"))


def _builds(spark, sf):
    st = F.create_map(*[F.lit(v) for v in ("F", "completed", "O", "running", "P", "failed")])
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        i.alias("id"), F.col("o_orderpriority").alias("domain"), st[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(i % 4 > 0, (i % 101).cast("double")).alias("quality_score"), F.when(i % 3 > 0, i % 50).alias("atoms_verified"), (i % 70).alias("atoms_extracted"),
        (F.floor(F.col("o_totalprice")) / 100).alias("api_cost_usd"))


_BUILDS = """b AS (SELECT o_orderkey AS id, o_orderpriority AS domain, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 101)::DOUBLE END AS q, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS v, o_orderkey % 70 AS x, floor(o_totalprice) / 100 AS c FROM orders)"""


@query("dashboard", "A16", f"""WITH {_BUILDS} SELECT coalesce(domain, 'all') AS domain, count(*) AS total_builds, count(*) FILTER (status = 'completed') AS completed_builds, round(avg(q), 1) AS avg_quality, sum(coalesce(v, x))::BIGINT AS total_atoms, round(sum(c), 2) AS total_cost, count(*) FILTER (status = 'running') AS running_builds
FROM b GROUP BY GROUPING SETS ((domain), ())""")
def dashboard(spark, sf):
    b = _builds(spark, sf)
    return R.dashboard(b, ["domain"]).unionByName(R.dashboard(b).withColumn("domain", F.lit("all")))


@query("domain_lessons", "A17", """
WITH f AS (SELECT user_id, event_id, 1 + event_id % 5 AS rating, CASE WHEN event_type <> 'view' THEN event_type || ' remark' ELSE '' END AS fb, CASE WHEN event_id % 2 = 0 THEN event_type || ', late' ELSE 'none' END AS iss FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM f WHERE fb <> '')
SELECT user_id, round(avg(rating), 6) AS avg_rating, string_agg(printf('%d. Rating: %d/5 | Issues: %s', r, rating, iss) || chr(10) || '   ' || fb, chr(10) ORDER BY r) AS lessons FROM r WHERE r <= 5 GROUP BY 1""")
def domain_lessons(spark, sf):
    i = F.col("event_id")
    f = table(spark, sf, "events").select(
        "user_id", "event_id", (1 + i % 5).alias("rating"), F.when(F.col("event_type") != "view", F.concat("event_type", F.lit(" remark"))).otherwise("").alias("feedback"),
        F.when(i % 2 == 0, F.to_json(F.array("event_type", F.lit("late")))).alias("issues"))
    return P.domain_lessons(f, "user_id", "event_id").withColumn("avg_rating", F.round("avg_rating", 6))


_MODELS = [*K.MODEL_PRICES, "other-model"]


@query("cost_accounting", "A18", f"""
WITH u AS (SELECT l_orderkey, l_linenumber, ([{', '.join(S.q(m) for m in _MODELS)}])[l_suppkey % {len(_MODELS)} + 1] AS model, (l_quantity * 100)::BIGINT AS i, (l_quantity * 37)::BIGINT AS o FROM lineitem),
p(model, a, b) AS (VALUES {', '.join(f"({S.q(m)}, {a}::DECIMAL(10,4), {b}::DECIMAL(10,4))" for m, (a, b) in K.MODEL_PRICES.items())})
SELECT l_orderkey, l_linenumber, round(sum(i * coalesce(a, 3.0) + o * coalesce(b, 15.0))::DOUBLE / 1000000, 6) AS cost_usd, sum(i + o)::BIGINT AS tokens FROM u LEFT JOIN p USING (model) GROUP BY 1, 2""")
def cost_accounting(spark, sf):
    m = F.element_at(F.array(*[F.lit(x) for x in _MODELS]), (F.col("l_suppkey") % len(_MODELS) + 1).cast("int"))
    u = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("model"), (F.col("l_quantity") * 100).cast("long").alias("input_tokens"),
                                            (F.col("l_quantity") * 37).cast("long").alias("output_tokens"))
    return R.cost(u, ["l_orderkey", "l_linenumber"]).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))


_NOW = "2024-01-31 00:00:00"


def _cache(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts"), F.length("props").cast("long").alias("bytes"))


@query("cache_stats", "A19", f"""SELECT event_type AS kind, count(*) AS entries, sum(length(props))::BIGINT AS bytes, round(max(epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 86400, 6) AS oldest_days,
 round(min(epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 86400, 6) AS newest_days FROM events GROUP BY 1""")
def cache_stats(spark, sf):
    return R.cache_stats(_cache(spark, sf), F.lit(_NOW).cast("timestamp"))


@query("cache_purge", "A19", f"SELECT event_id, event_type AS kind FROM events WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY")
def cache_purge(spark, sf):
    return R.cache_purge(_cache(spark, sf), F.lit(_NOW).cast("timestamp"), 7).select("event_id", "kind")


# --- publishing ----------------------------------------------------------------------------------


@query("build_metadata", "A2", f"""
WITH {_ATOMS}, p AS (SELECT build, category, count(*) FILTER (status <> 'flagged') AS k FROM atoms GROUP BY 1, 2), m AS (SELECT build, string_agg(category || '=' || k, ',' ORDER BY category) AS pillars FROM p WHERE k > 0 GROUP BY 1)
SELECT build, count(*) AS atoms_total, count(*) FILTER (status <> 'flagged') AS atoms_included, count(*) FILTER (status = 'flagged') AS atoms_flagged, any_value(pillars) AS pillars, round_even(avg(confidence) FILTER (status <> 'flagged'), 3) AS avg_confidence FROM atoms JOIN m USING (build) GROUP BY 1""")
def build_metadata(spark, sf):
    m = P.build_metadata(_atoms(spark, sf), "build")
    pairs = F.transform(F.map_entries("pillars"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.withColumn("pillars", F.array_join(pairs, ","))


@query("package_stats", "A3", f"""WITH {_ATOMS} SELECT category, count(*) AS total_atoms, count(*) FILTER (status IN ('verified', 'updated')) AS verified, count(*) FILTER (source = 'transcript') AS from_transcript, count(*) FILTER (source = 'baseline') AS from_baseline,
 count(*) FILTER (source = 'codebase') AS from_codebase, round_even(count(*) FILTER (status IN ('verified', 'updated'))::DOUBLE / count(*) * 100, 1) AS verified_pct FROM atoms GROUP BY 1""")
def package_stats(spark, sf):
    return P.package_stats(_atoms(spark, sf), ["category"])


@query("code_patterns", "A4", f"""
WITH p AS (SELECT p_partkey, list_filter([lower(p_type), ([{', '.join(S.q(t) for t in K.PATTERN_TYPES)}])[p_size % 7 + 1], 'function'], lambda t: t IN {S.in_list(K.PATTERN_TYPES)})[1] AS t FROM part WHERE p_size % 5 > 0 UNION ALL SELECT p_partkey, 'general' FROM part WHERE p_size % 5 = 0)
SELECT t AS pattern, count(*) AS patterns, min(p_partkey) AS first_part FROM p GROUP BY 1""")
def code_patterns(spark, sf):
    kinds = F.array(*[F.lit(t) for t in K.PATTERN_TYPES])
    tags = F.when(F.col("p_size") % 5 > 0, F.array(F.lower("p_type"), F.element_at(kinds, (F.col("p_size") % 7 + 1).cast("int")), F.lit("function"))).otherwise(F.array(F.lower("p_type")))
    p = table(spark, sf, "part").select("p_partkey", P.pattern_type(tags, K.PATTERN_TYPES).alias("pattern"))
    return p.groupBy("pattern").agg(F.count("*").alias("patterns"), F.min("p_partkey").alias("first_part"))


_LEVEL = f"CASE WHEN TRY_CAST(nullif(regexp_extract(verification_note, 'score{T.WS}+([0-9.]+)', 1), '') AS DOUBLE) IS NOT NULL OR baseline_reference IS NOT NULL THEN 'VERIFIED' ELSE 'UNVERIFIED' END"


@query("confidence_map", "A21", f"""
WITH {_ATOMS}, l AS (SELECT *, {_LEVEL} AS level FROM atoms), r AS (SELECT level, title, row_number() OVER (PARTITION BY level ORDER BY idx) AS r, CASE WHEN level = 'UNVERIFIED' THEN 10 ELSE 15 END AS m FROM l)
SELECT level, count(*) AS atoms, string_agg(title, '|' ORDER BY r) FILTER (r <= m) AS titles, greatest(count(*) - any_value(m), 0) AS more FROM r GROUP BY 1""")
def confidence_map(spark, sf):
    a = _atoms(spark, sf).withColumn("level", P.confidence_level(F.col("verification_note"), F.col("baseline_reference")))
    return P.confidence_map(a, "level", "idx", "title").withColumn("titles", F.array_join("titles", "|"))


@query("confidence_levels", "A21", f"""
WITH {_ATOMS}, s AS (SELECT idx, baseline_reference AS ref, TRY_CAST(nullif(regexp_extract(verification_note, 'score{T.WS}+([0-9.]+)', 1), '') AS DOUBLE) AS s FROM atoms)
SELECT idx, CASE WHEN s >= 0.7 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' WHEN s IS NOT NULL THEN 'LOW' WHEN ref IS NOT NULL THEN 'HIGH' ELSE 'LOW' END AS level FROM s""")
def confidence_levels(spark, sf):
    return _atoms(spark, sf).select("idx", P.confidence_level(F.col("verification_note"), F.col("baseline_reference"), levels=4).alias("level"))


_TIP = "CASE WHEN idx % 3 = 0 THEN 'Expert insight — not found in official docs' WHEN idx % 3 = 1 THEN 'Verified' END"


@query("top_strategies", "A22", f"WITH {_ATOMS} SELECT idx, title FROM atoms WHERE idx % 3 > 0 AND confidence >= 0.9::DOUBLE ORDER BY idx LIMIT 10")
def top_strategies(spark, sf):
    note = F.when(F.col("idx") % 3 == 0, "Expert insight — not found in official docs").when(F.col("idx") % 3 == 1, "Verified")
    return P.top_strategies(_atoms(spark, sf).withColumn("note", note), "note", "idx").select("idx", "title")


@query("tip_classes", "A22", f"WITH {_ATOMS} SELECT category, count(*) FILTER (idx % 3 = 0) AS expert_tips, count(*) FILTER (idx % 3 > 0) AS verified FROM atoms GROUP BY 1")
def tip_classes(spark, sf):
    note = F.when(F.col("idx") % 3 == 0, "Expert insight — not found in official docs").when(F.col("idx") % 3 == 1, "Verified")
    a = _atoms(spark, sf).withColumn("tip", P.is_expert_tip(note))
    return a.groupBy("category").agg(F.count(F.when(F.col("tip"), 1)).alias("expert_tips"), F.count(F.when(~F.col("tip"), 1)).alias("verified"))


@query("pillar_documents", "A28", f"""
WITH {_ATOMS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY idx) AS n, '## ' || title || {S.NL} || {S.NL} || content || {S.NL} || {S.NL} || '*Tags: ' || array_to_string(tags, ', ') || '*' || {S.NL} AS md FROM atoms),
p AS (SELECT *, CAST((sum(length(md) + 1) OVER (PARTITION BY category ORDER BY n) - length(md) - 1) // {P.PART_CHARS} AS BIGINT) AS part FROM r)
SELECT category, part, count(*) AS atoms, CASE WHEN part = 0 THEN '# ' || category || {S.NL} || {S.NL} ELSE '' END || string_agg(md, {S.NL} ORDER BY n) AS markdown FROM p GROUP BY category, part""")
def pillar_documents(spark, sf):
    return P.pillar_parts(_atoms(spark, sf), "category", "idx")


@query("routing_section", "A28", f"""
WITH {_ATOMS}, r AS (SELECT build AS category, title, row_number() OVER (PARTITION BY build ORDER BY idx) AS r FROM atoms)
SELECT category, '- If user asks about **' || upper(left(category, 1)) || substring(category, 2) || '** (' || string_agg(title, ', ' ORDER BY r) || ') -> see `knowledge/' || category || '.md`' AS line FROM r WHERE r <= 3 GROUP BY 1""")
def routing_section(spark, sf):
    a = _atoms(spark, sf).select(F.col("build").alias("category"), "title", "idx")
    return P.routing(a, "category", "idx")


_DESC = "substring(text, 1, CAST(n_chars // 3 AS INT))"


@query("document_lint", "A24", f"""
WITH d AS (SELECT doc_id, {_DESC} AS descr, '---' || {S.NL} || 'a: b' || {S.NL} || '---' || {S.NL} || replace(text, ' ', {S.NL}) AS body, replace(text, '. ', '.' || {S.NL}) || CASE WHEN doc_id % 2 = 0 THEN {S.NL} || '## Table of Contents' ELSE '' END AS kb FROM documents)
SELECT doc_id, concat_ws('; ', CASE WHEN length(descr) > 1024 THEN 'description over 1024 characters' END, CASE WHEN {S.words('descr')} > 200 THEN 'description over 200 words' END, CASE WHEN {S.words('descr')} < 50 THEN 'description under 50 words' END,
 CASE WHEN len(string_split(body, {S.NL})) - 3 > 500 THEN 'body over 500 lines' END) AS warnings, len(string_split(kb, {S.NL})) > 300 AND doc_id % 2 = 1 AS knowledge_warning FROM d""")
def document_lint(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int")).alias("d"), F.concat(F.lit("---\na: b\n---\n"), F.replace("text", F.lit(" "), F.lit("\n"))).alias("b"),
        F.concat(F.replace("text", F.lit(". "), F.lit(".\n")), F.when(F.col("doc_id") % 2 == 0, "\n## Table of Contents").otherwise("")).alias("k"))
    return d.select("doc_id", F.array_join(P.lint_document(F.col("d"), F.col("b")), "; ").alias("warnings"), P.lint_knowledge(F.col("k")).alias("knowledge_warning"))


@query("progress_and_age", "A27", f"""
SELECT event_id, CAST(floor((event_id % 7) * (100 / 7::DOUBLE) + (event_id % 101) / 100::DOUBLE * (100 / 7::DOUBLE) + 0.5) AS INT) AS progress,
 CASE WHEN m > 60 THEN printf('%dh %dm', m // 60, m % 60) ELSE printf('%dm %ds', m, s % 60) END AS duration,
 CASE WHEN a // 86400 > 0 THEN printf('%d ngày trước', a // 86400) WHEN a // 3600 > 0 THEN printf('%d giờ trước', a // 3600) WHEN a // 60 > 0 THEN printf('%d phút trước', a // 60) ELSE 'vừa xong' END AS age
FROM (SELECT event_id, CAST(value * 60 AS BIGINT) AS s, CAST(value * 60 AS BIGINT) // 60 AS m, CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events)""")
def progress_and_age(spark, sf):
    e = table(spark, sf, "events")
    phase = F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string"))
    start = F.timestamp_seconds(F.lit(1700000000))
    end = F.timestamp_seconds(F.lit(1700000000) + F.round(F.col("value") * 60).cast("long"))
    return e.select("event_id", P.overall_progress(phase, F.col("event_id") % 101).alias("progress"), P.duration(start, end).alias("duration"),
                    P.age(F.col("ts"), F.lit(_NOW).cast("timestamp")).alias("age"))


@query("diverse_top", "W3", f"""
WITH {_ATOMS}, a AS (SELECT idx, build AS category, confidence, row_number() OVER (PARTITION BY build ORDER BY confidence DESC, idx) AS r FROM atoms),
h AS (SELECT idx, category, confidence, 0 AS t FROM a WHERE r = 1 AND (SELECT count(*) FROM a) > 0 UNION ALL SELECT idx, category, confidence, 1 FROM a WHERE r > 1)
SELECT idx, category, round(confidence, 6) AS confidence FROM h ORDER BY t, confidence DESC, idx LIMIT 8""")
def diverse_top(spark, sf):
    a = _atoms(spark, sf).select("idx", F.col("build").alias("category"), "confidence")
    return P.diverse_top(a, "category", "idx").withColumn("confidence", F.round("confidence", 6))


@query("diverse_top_few_categories", "W3", f"""
WITH {_ATOMS}, a AS (SELECT idx, category, confidence, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, idx) AS r FROM atoms)
SELECT idx, category, round(confidence, 6) AS confidence FROM a ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, a.confidence DESC, idx LIMIT 8""")
def diverse_top_few_categories(spark, sf):
    a = _atoms(spark, sf).select("idx", "category", "confidence")
    return P.diverse_top(a, "category", "idx").withColumn("confidence", F.round("confidence", 6))


@query("test_contexts", "W4", f"""
WITH {_ATOMS}, t AS (SELECT item_id AS test_id, ['fr', 'de', '', 'es', 'en'][item_id % 5 + 1] AS cat, regexp_extract(lower(text), '^[^ ]+') AS st FROM benchmark ORDER BY item_id LIMIT 5),
x AS (SELECT test_id, idx, '### ' || title || {S.NL} || left(content, 400) || {S.NL} AS entry, CASE WHEN contains(lower(title), st) OR (cat <> '' AND cat = lower(category)) THEN 0 ELSE 1 END AS p, confidence FROM t CROSS JOIN atoms),
r AS (SELECT test_id, entry, row_number() OVER w AS pos, sum(length(entry)) OVER w AS s FROM x WINDOW w AS (PARTITION BY test_id ORDER BY p, CASE WHEN p = 0 THEN 0 ELSE -confidence END, idx))
SELECT test_id, pos, entry FROM r WHERE s <= 4000""")
def test_contexts(spark, sf):
    cats = F.array(*[F.lit(c) for c in ("fr", "de", "", "es", "en")])
    t = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("test_id"), F.element_at(cats, (F.col("item_id") % 5 + 1).cast("int")).alias("category"),
        F.array(F.regexp_extract(F.lower("text"), "^[^ ]+", 0)).alias("titles"))
    return P.test_contexts(t, _atoms(spark, sf), "idx")


@query("inline_references", "W5", f"""
WITH k AS (SELECT sum(length(text) + 1) + 100 AS u FROM benchmark), t AS (SELECT sum(length(text) + 2) - 2 AS t FROM documents),
b AS (SELECT CASE WHEN u + t > 50000 THEN greatest(50000 - u - 200, 0) ELSE t END AS b FROM k CROSS JOIN t),
r AS (SELECT doc_id AS ord, text, coalesce(sum(length(text) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents)
SELECT ord, left(text, CAST(b - s AS INT)) AS text, b - s < length(text) AS is_cut FROM r CROSS JOIN b WHERE b - s > 0""")
def inline_references(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.inline_references(table(spark, sf, "benchmark").select("text"), d, "doc_id", "text", overhead=100)


_INLINE = 100_000


@query("inlined_document", "W5", f"""
WITH k AS (SELECT sum(length(text) + 1) + 100 AS u FROM benchmark), r AS (SELECT page_id AS ord, url AS text FROM pages),
rt AS (SELECT sum(length(text) + 2) - 2 AS t FROM r), rb AS (SELECT CASE WHEN u + t > {_INLINE} THEN greatest({_INLINE} - u - 200, 0) ELSE t END AS b, u + t > {_INLINE} AS cut, u FROM k CROSS JOIN rt),
rp AS (SELECT *, coalesce(sum(length(text) + 2) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r),
x AS (SELECT conv_id * 1000 + turn AS ord, text FROM conversations WHERE length(text) > 0), xt AS (SELECT sum(length(text) + 2) - 2 AS t FROM x),
ub AS (SELECT u + b + CASE WHEN cut THEN 44 ELSE 0 END AS u2 FROM rb),
xb AS (SELECT CASE WHEN u2 + t < {_INLINE} THEN t WHEN {_INLINE} - u2 > 1000 THEN least(t, {_INLINE} - u2 - 200) ELSE 0 END AS b FROM ub CROSS JOIN xt),
xp AS (SELECT *, coalesce(sum(length(text) + 2) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x)
SELECT 'reference' AS part, ord, left(text, CAST(b - s AS INT)) AS text, b - s < length(text) AS is_cut FROM rp CROSS JOIN rb WHERE b - s > 0
UNION ALL SELECT 'example', ord, left(text, CAST(b - s AS INT)), b - s < length(text) FROM xp CROSS JOIN xb WHERE b - s > 0""")
def inlined_document(spark, sf):
    refs = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("text"))
    examples = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return P.inline_document(table(spark, sf, "benchmark").select("text"), refs, examples, "ord", "text", 100, _INLINE)


@query("build_listing", "W6", f"WITH {_BUILDS} SELECT id, domain, status FROM b WHERE status = 'completed'")
def build_listing(spark, sf):
    return P.builds_listing(_builds(spark, sf), "completed").select("id", "domain", "status")


@query("template_listing", "W6", "SELECT p_partkey AS id, p_type AS name, p_partkey % 7 = 0 AS is_default, p_size AS usage_count FROM part")
def template_listing(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), (F.col("p_partkey") % 7 == 0).alias("is_default"), F.col("p_size").alias("usage_count"))
    return P.templates_listing(p)


@query("baseline_registry", "W6", """
WITH b AS (SELECT o_custkey AS c_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'ready' ELSE 'pending' END, o_orderkey) AS s, arg_max(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'dir' END, ''), o_orderkey) AS p, arg_max(o_orderkey % 20, o_orderkey) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN s IS NULL THEN 'none' WHEN s = 'ready' AND p <> '' THEN 'ready' ELSE 'pending' END AS baseline, CASE WHEN s = 'ready' AND p <> '' THEN n ELSE 0 END AS refs_count FROM customer LEFT JOIN b USING (c_custkey)""")
def baseline_registry(spark, sf):
    i = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), i, F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"),
                                          F.when(i % 3 > 0, "dir").alias("path"), (i % 20).alias("refs_count"))
    return P.baseline_status(table(spark, sf, "customer").select("c_custkey"), b, "c_custkey", "o_orderkey")


@query("log_page", "W7", "SELECT event_id AS id, event_type AS level FROM events WHERE user_id = 8 AND event_id > 100 AND event_type = 'error' ORDER BY event_id LIMIT 500")
def log_page(spark, sf):
    logs = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("level"))
    return P.log_page(logs, "user_id", 8, after=100, level="error").select("id", "level")


@query("build_comparison", "J22", f"""
WITH b AS (SELECT o_orderkey AS id, o_totalprice AS cost, CASE WHEN o_orderkey % 2 = 0 THEN 'report ' || o_orderkey ELSE 'front ' || o_orderpriority END AS description FROM orders)
SELECT a.id AS a_id, a.cost AS a_cost, a.description AS a_description, o.id AS b_id, o.cost AS b_cost, o.description AS b_description FROM b a JOIN b o ON o.id = a.id + 1""")
def build_comparison(spark, sf):
    i = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(
        i.alias("id"), F.col("o_totalprice").alias("cost"), F.when(i % 2 == 0, F.concat(F.lit("report "), i.cast("string"))).alias("report_description"),
        F.concat(F.lit("---\nname: x\ndescription: >\n  front\n  "), "o_orderpriority", F.lit("\nversion: 1\n---\nbody")).alias("document"))
    pairs = b.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return P.compare_builds(b, pairs, "id")


# --- incremental ---------------------------------------------------------------------------------


_CACHED = f"""f AS (SELECT doc_id, source, left(sha256(left(sha256(text), 16) || ':m1:v3:standard'), 16) AS key FROM documents),
c AS (SELECT key, max(TIMESTAMP '{_NOW}' - to_days(CAST(doc_id % 40 AS INT))) AS ts FROM f WHERE doc_id % 3 = 0 GROUP BY 1)"""


def _files(spark, sf):
    h = T.content_key(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "source", h.alias("hash"), I.atoms_key(h, F.lit("m1"), F.lit("v3"), F.lit("standard")).alias("key"))


def _split(spark, sf):
    f = _files(spark, sf)
    ts = F.lit(_NOW).cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 40).cast("int"))
    cache = f.filter("doc_id % 3 = 0").select("key", ts.alias("ts")).groupBy("key").agg(F.max("ts").alias("ts"))
    return I.split_hits(f.select("doc_id", "key"), cache, "key", F.lit(_NOW).cast("timestamp"))


@query("cache_hits", "J19", f"WITH {_CACHED} SELECT doc_id, key FROM f JOIN c USING (key) WHERE epoch(TIMESTAMP '{_NOW}') - epoch(ts) <= 30 * 86400")
def cache_hits(spark, sf):
    return _split(spark, sf)[0].select("doc_id", "key")


@query("cache_misses", "J19", f"WITH {_CACHED} SELECT doc_id, key FROM f WHERE key NOT IN (SELECT key FROM c WHERE epoch(TIMESTAMP '{_NOW}') - epoch(ts) <= 30 * 86400)")
def cache_misses(spark, sf):
    return _split(spark, sf)[1].select("doc_id", "key")


@query("file_set_keys", "J19", """
WITH h AS (SELECT source, left(sha256(text), 16) AS h FROM documents)
SELECT source, count(*) AS n, left(sha256(concat_ws(':', source, string_agg(h, ':' ORDER BY h), 'm1', 'standard')), 16) AS set_key FROM h GROUP BY 1""")
def file_set_keys(spark, sf):
    return I.file_set_key(_files(spark, sf), "source", "hash", "doc_id", "m1", "standard")


# Every third text is stored, some too long ago; what is missing gets its vector and is found the second time.
@query("embedding_cache", "J19", f"""
WITH f AS (SELECT doc_id, left(sha256(left(sha256(text), 16) || ':m1'), 16) AS key FROM documents), e AS (SELECT vec_id, embedding FROM embeddings),
c AS (SELECT key, arg_max(embedding, ts) AS embedding, max(ts) AS ts FROM (SELECT key, embedding, TIMESTAMP '{_NOW}' - to_seconds(vec_id % 40 * 86400 + vec_id) AS ts FROM f JOIN e ON vec_id = doc_id WHERE doc_id % 3 = 0) GROUP BY 1),
l AS (SELECT key, embedding FROM c WHERE epoch(TIMESTAMP '{_NOW}') - epoch(ts) <= 30 * 86400)
SELECT doc_id, key, l.key IS NOT NULL AS first_hit, round(CASE WHEN l.key IS NULL THEN ('0x' || substring(key, 1, 6))::BIGINT ELSE list_sum(embedding::DOUBLE[]) END, 4) AS total FROM f LEFT JOIN l USING (key)""")
def embedding_cache(spark, sf):
    now, path = F.lit(_NOW).cast("timestamp"), f"{shared_dir(spark)}/quillstone/vectors-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    stored = d.filter(F.col("doc_id") % 3 == 0).join(e, "doc_id")
    age = F.col("doc_id") % 40 * 86400 + F.col("doc_id")
    hashed = T.content_key(F.col("text"))
    stored = stored.select(I.vector_key(hashed, F.lit("m1")).alias("key"), hashed.alias("text_hash"), "vector", F.timestamp_seconds(F.unix_timestamp(now) - age).alias("ts"))
    I.append_vectors(stored, "m1", path, F.col("ts"))
    hits, misses = I.split_vectors(d, "text", "m1", I.read_vectors(spark, path), now)
    first = materialise(hits.select("doc_id"), "hits").withColumn("_hit", F.lit(True))
    made = misses.select("key", "text_hash", F.array(F.conv(F.substring("key", 1, 6), 16, 10).cast("double")).alias("vector"))  # stands for the model's answer
    I.append_vectors(materialise(made, "made"), "m1", path, now)
    again, none = I.split_vectors(d, "text", "m1", I.read_vectors(spark, path), now)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4)
    return again.join(first, "doc_id", "left").select("doc_id", "key", F.coalesce("_hit", F.lit(False)).alias("first_hit"), total.alias("total"))
