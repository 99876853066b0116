"""Typed rows out of model answers that should be JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


def strip_fences(c: Column) -> Column:
    """Remove an opening code fence line and a closing fence."""
    c = T.strip(c)
    c = F.when(c.startswith("```"), F.regexp_replace(c, r"(?s)\A```(?:[^\n]*\n)?", "")).otherwise(c)
    return T.strip(F.when(c.endswith("```"), F.regexp_replace(c, r"```\z", "")).otherwise(c))


def outermost(c: Column) -> Column:
    """First opening to last closing bracket; null when there is none."""
    found = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(found, F.lit(""))


@F.pandas_udf(StringType())
def close_truncated(texts: pd.Series) -> pd.Series:
    """Close strings and brackets left open by a cut answer; null when not repairable."""
    import json
    import re

    opens = {"{": "}", "[": "]"}
    piece = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]{}]', re.S)

    def repair(text):
        begin = re.search(r"[\[{]", text or "")
        if not begin:
            return None
        body, pending, cut_string = text[begin.start():], [], False
        for m in piece.finditer(body):
            tok = m.group()
            if tok in opens:
                pending.append(opens[tok])
            elif tok in "]}":
                if pending and pending[-1] == tok:
                    pending.pop()
            else:
                cut_string = m.end() == len(body) and (len(tok) == 1 or not re.search(r'(?<!\\)(?:\\\\)*"\Z', tok[1:]))
        if not pending:
            return None
        body = body.rstrip() + ('"' if cut_string else "")
        fixed = re.sub(r"[,:\s]+\Z", "", body) + "".join(reversed(pending))
        try:
            json.loads(fixed)
        except ValueError:
            return None
        return fixed

    return texts.map(repair)


def ingest(answers: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``parsed`` (struct of ``schema``) and ``parse_status``.

    parsed: valid after fence removal; extracted: valid outermost span;
    repaired: closed after truncation; quarantined: none of these.  Python
    sees only the rows the JSON functions could not read.
    """
    body = strip_fences(F.col(text))
    staged = answers.withColumn("_body", body).withColumn("_span", outermost(F.col("_body")))

    def valid(c: str) -> Column:
        return F.get_json_object(c, "$").isNotNull() & F.col(c).rlike(r"(?s)\A[\[{].*[\]}]\z")

    staged = staged.withColumn(
        "parse_status", F.when(valid("_body"), "parsed").when(valid("_span"), "extracted")
    )
    fine = staged.filter(F.col("parse_status").isNotNull()).withColumn(
        "_json", F.when(F.col("parse_status") == "parsed", F.col("_body")).otherwise(F.col("_span"))
    )
    broken = staged.filter(F.col("parse_status").isNull()).withColumn("_json", close_truncated("_body"))
    broken = broken.withColumn(
        "parse_status", F.when(F.col("_json").isNotNull(), "repaired").otherwise("quarantined")
    )
    both = fine.unionByName(broken)
    return both.withColumn("parsed", F.from_json("_json", schema)).drop("_body", "_span", "_json")
