"""Physical plans: no cross joins, pruned and pushed-down scans, no needless shuffles."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from quillstone.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SKIP = ("live_", "log_tail")


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return text_of(QUERIES[name](spark, SF))


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that a query writes on its way."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        plans.append(text_of(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


@pytest.fixture
def no_broadcast(spark):
    """Small test tables would hide a join that has no key."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(SKIP)))
def test_no_plan_holds_a_cross_join(spark, written, no_broadcast, name):
    for p in [plan(spark, name), *written]:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", p)


def test_text_work_needs_no_shuffle(spark):
    for name in ("clean_transcript", "keywords_verify", "snippets", "cut_at_sentence", "titles", "markdown_sections", "page_text"):
        # The only exchange is the test tables' spread of a single split.
        assert len(re.findall(r"Exchange (?!RoundRobin)", plan(spark, name))) == 0, name


def test_scans_read_what_is_used(spark):
    p = plan(spark, "log_page")
    assert "PushedFilters" in p and "EqualTo(user_id,8)" in p
    assert "props" not in re.search(r"ReadSchema: \S+", p).group()
    p = plan(spark, "cost_accounting")
    assert "l_shipdate" not in p


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    for name in ("topic_labels", "front_matter_samples", "log_replay"):
        assert "WindowGroupLimit" in plan(spark, name), name


@pytest.mark.parametrize("name", ["html_to_markdown", "sanitise_ocr"])
def test_whole_texts_go_to_python_in_small_batches(spark, name):
    """an Arrow batch holds 10,000 whole texts or pages."""
    p = plan(spark, name)
    assert len(re.findall(r"BatchEvalPython", p)) == 1 and not re.search("ArrowEvalPython|MapInPandas", p)
