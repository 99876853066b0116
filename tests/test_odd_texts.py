"""Queries against their SQL where texts are null, empty or blank, or their letters have odd cases."""

import duckdb
import pytest

from quillstone.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

TEXTS = [None, "", " ", "\n", "\t\n", "\r\n", " \n ", "word", "a\n\n\n\nb \t", "Page 4\n- 7 -\n3 / 9", "x. y. z",
         "\u0130stanbul", "\u03a3\u0391\u03a3 one", "\u03c3\u03b1\u03c3 two"]
LINES = ("clean_normalize_ws", "clean_page_numbers", "clean_header_footer", "clean_toc", "clean_watermarks", "clean_merge_blanks",
         "clean_transcript", "heading_levels")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    rows = [(i, t, None if i % 7 == 0 else f"l{i % 5}", f"src{i % 4}", len(t or "")) for i, t in enumerate(TEXTS * 3)]
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    return folder, con


def same(spark, odd, name):
    ok, detail, _ = compare(spark, odd[1], QUERIES[name], ORACLES[name], odd[0], name)
    assert ok, detail


@pytest.mark.parametrize("name", LINES)
def test_an_empty_text_is_one_line(spark, odd, name):
    """F7, F8: empty texts had no line where the SQL has an empty one."""
    same(spark, odd, name)


@pytest.mark.parametrize("name", ["topic_merge", "topic_files"])
def test_texts_without_a_word_share_a_topic(spark, odd, name):
    """they were left out, a null field hid a later one, and odd letters had another lower case."""
    same(spark, odd, name)
