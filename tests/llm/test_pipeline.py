import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillstone.llm import simhash
from quillstone.llm.queries import ORACLES, QUERIES
from quillstone.session import materialise
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
TABLES = {
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    ok, detail, rows = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok and rows, detail


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_empty_tables(spark, documents, odd, tmp_path, name, stage):
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = materialise(documents(odd), "odd")
    got = stage(spark, docs, str(tmp_path))
    if name != "byte_bpe":
        assert got.columns == docs.columns
    classes = len({simhash.fingerprint(t or "") for _, t in odd})
    assert got.count() == (classes if name.startswith("simhash") else len(odd))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.collect()}
        assert now <= left and len(now) == docs.count()
        if name in ("pii", "byte_bpe"):
            assert now == left
        left = now
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))
    toxic = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where toxic = 0").fetchall()}
    assert len(toxic & left) > 0.5 * len(toxic)
