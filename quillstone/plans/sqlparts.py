"""Pieces of oracle SQL shared by the plan modules (DuckDB dialect)."""

from __future__ import annotations

from ..functions import text as T

WSQ = "'" + T.WS_CHARS + "'"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WSQ})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WSQ})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{T.NOT_WS}+')) AS BIGINT)"


def word_list(x: str) -> str:
    return f"regexp_extract_all({x}, '{T.NOT_WS}+')"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def tokens(x: str, shortest: int = 3) -> str:
    return f"regexp_extract_all(lower({x}), '{T.WORD}{{{shortest},}}')"


def _keep(stop, longest) -> str:
    cond = "NOT regexp_full_match(t, '\\p{Nd}+')"
    if stop:
        cond += f" AND t NOT IN {in_list(stop)}"
    if longest:
        cond += f" AND length(t) <= {longest}"
    return cond


def keywords(name: str, src: str, id_: str, text: str, k: int, stop=(), shortest=3, longest=None) -> str:
    """CTE ``name(id, kw, r)``: top-k keywords of ``text`` per ``id_``."""
    return f"""
    {name}_a AS (SELECT {id_} AS id, {tokens(text, shortest)} AS toks FROM {src}),
    {name}_b AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM {name}_a),
    {name} AS (SELECT id, t AS kw, r FROM (
        SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS r FROM (
            SELECT id, t, count(*) AS n, min(i) AS p FROM {name}_b WHERE {_keep(stop, longest)} GROUP BY id, t))
        WHERE r <= {k})"""


def keyword_set(name: str, src: str, id_: str, text: str, stop=()) -> str:
    """CTE ``name(id, kw)``: distinct keywords of ``text`` per ``id_``."""
    return f"""
    {name}_b AS (SELECT {id_} AS id, unnest({tokens(text)}) AS t FROM {src}),
    {name} AS (SELECT DISTINCT id, t AS kw FROM {name}_b WHERE {_keep(stop, None)})"""
