"""Stated cases for rules that the synthetic tables do not reach."""

import numpy as np
import pytest

from quillstone.operators import dedup as D, publish as P, similarity as Z, urls as U

TEST = "test_id long, category string, titles array<string>"


def test_context_budget_takes_the_shortest_entries(spark):
    """Empty titles and bodies give six characters each, and 4000 // 6 of them fit."""
    atoms = spark.createDataFrame([(i, "", "", "fr", 0.5) for i in range(700)], "idx long, title string, content string, category string, confidence double")
    tests = spark.createDataFrame([(1, "de", [])], TEST)
    assert P.test_contexts(tests, atoms, "idx").count() == 666


def test_contexts_are_for_the_first_five_tests(spark):
    atoms = spark.createDataFrame([(1, "a", "b", "fr", 0.5)], "idx long, title string, content string, category string, confidence double")
    tests = spark.createDataFrame([(i, "", []) for i in range(12, 0, -1)], TEST).repartition(4)
    assert {r.test_id for r in P.test_contexts(tests, atoms, "idx").collect()} == {1, 2, 3, 4, 5}


def test_dense_pairs_multiply_each_pair_of_blocks_once(spark):
    rng = np.random.default_rng(4)
    sides = []
    for n in (130, 90):
        v = rng.normal(size=(n, 8))
        v[0] = 0  # a zero vector has no direction and no partner
        sides.append(v)
    frames = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>") for v in sides]
    unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in sides]
    want = {(i, j) for i, j in zip(*np.nonzero(unit[0] @ unit[1].T >= 0.5))}
    rows = Z.dense_pairs(*frames, 0.5, block_rows=25).collect()
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want


def test_dense_pairs_repeat_a_row_for_few_blocks(spark):
    """9,000 rows a side: 8 blocks, not one per 1,000 rows; a block larger than a slice loses nothing."""
    rng = np.random.default_rng(6)
    sides = [rng.normal(size=(9000, 4)).round(1) for _ in range(2)]
    frames = [spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>") for v in sides]
    unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in sides]
    want = np.argwhere(unit[0] @ unit[1].T >= 0.9999)
    pairs = Z.dense_pairs(*frames, 0.9999)
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(map(tuple, want.tolist()))
    assert Z.BLOCK_ROWS >= 8 * Z.SLICE


def test_keywords_see_the_title_but_numbers_do_not(spark):
    schema = "{0} long, title string, content string, gap_filled boolean"
    left = spark.createDataFrame([(1, "budget pacing rules 7", "daily spend limit works", False)], schema.format("t"))
    right = spark.createDataFrame([(2, "budget pacing rules 9", "weekly reports arrive late", False)], schema.format("b"))
    with_title = D.issue_pairs(left, right, "t", "b", "content", 0.6, title="title").collect()
    without = D.issue_pairs(left, right, "t", "b", "content", 0.6).collect()
    assert without == [] and with_title == []  # three of seven words in common; the digits are the title's
    closer = spark.createDataFrame([(2, "budget pacing rules 9", "daily spend never", False)], schema.format("b"))
    assert [r.issue for r in D.issue_pairs(left, closer, "t", "b", "content", 0.6, title="title").collect()] == ["duplicate"]


def test_same_text_under_two_titles_stays_two_atoms(spark):
    rows = [(0, "x", "alpha beta gamma", "transcript", 0.5, False), (1, "y", "alpha beta gamma", "transcript", 0.4, False), (2, "x", "alpha beta gamma", "baseline", 0.45, False)]
    atoms = spark.createDataFrame(rows, "idx long, title string, text string, source string, confidence double, gap_filled boolean")
    out = D.cross_source_dedup(atoms, 0.6)
    assert "_digest" not in out["atoms"].columns
    assert {r.idx for r in out["removed"].collect()} == {2}


def test_sitemaps(spark):
    xml = {
        "root": "<sitemapindex><sitemap><loc>one</loc></sitemap><sitemap><loc>none</loc></sitemap></sitemapindex>",
        "one": "<urlset>" + "".join(f"<url><loc>https://h/{i}?a=1&amp;b=2</loc></url>" for i in range(60)) + "</urlset>",
        "bad": "<html>not one</html>",
    }
    maps = spark.createDataFrame(list(xml.items()), "url string, xml string")
    roots = spark.createDataFrame([("root",), ("bad",), ("missing",)], "url string")
    got = U.sitemap_links(maps, roots, "url", "xml").orderBy("root", "pos").collect()
    assert [(r.root, r.pos, r.link) for r in got] == [("root", i, f"https://h/{i}?a=1&b=2") for i in range(50)]
    assert U.sitemap_links(maps, roots, "url", "xml", ("/7?",)).count() == 1


def test_links_resolve_like_a_browser(spark):
    page = "https://h.org/a/b/c?z=1#f"
    cases = {
        "../x": "https://h.org/a/x", "./y": "https://h.org/a/b/y", "?q=1": "https://h.org/a/b/c?q=1", "": page, "//h.org/z": "https://h.org/z",
        "/k/../l": "https://h.org/l", "../../../up": "https://h.org/up", "javascript:void(0)": None, "tel:123": None, "mailto:a@b": None, "#top": None,
        "https://other.org/x": None, "https://h.org/a/./b": "https://h.org/a/./b",
    }
    html = "".join(f'<a class="k" href="{h}">x</a>' for h in cases)
    got = U.page_links(spark.createDataFrame([(page, html)], "url string, html string"), "url", "html").orderBy("pos").collect()
    assert [r.link for r in got] == [u for u in cases.values() if u]


def test_contents_of_conflicts_are_not_repeated_for_every_salt(spark, monkeypatch):
    """A hot atom, an unused one, an unknown one and a null id; no text passes through the salted join."""
    from quillstone.operators import conflicts as X

    salted = X.salted_join

    def narrow(big, small, *args, **kw):
        assert not [c for c in small.columns if c.endswith("content")]
        return salted(big, small, *args, **kw)

    monkeypatch.setattr(X, "salted_join", narrow)
    monkeypatch.setattr(X, "USES", 3)
    atoms = spark.createDataFrame([("x", "text x"), ("y", "text y"), ("z", "unused")], "id string, content string")
    rows = [(f"c{i}", "x", "y" if i % 2 else "gone") for i in range(20)] + [("c20", None, "x")]
    out = X.with_contents(spark.createDataFrame(rows, "conflict_id string, a_id string, b_id string"), atoms)
    known = {"x": "text x", "y": "text y"}
    assert sorted(tuple(r) for r in out.select("conflict_id", "a_content", "b_content").collect()) == sorted(
        (c, known.get(a, ""), known.get(b, "")) for c, a, b in rows)


def test_tfidf_does_not_repeat_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a b b", 2), (2, "b c", 1)], "id long, t string, copies long")
    vec = Z.tfidf(docs, "id", "t")
    assert "_salt" not in vec._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.term): (r.tf, r.df) for r in vec.collect()} == {(1, "a"): (1 / 3, 2), (1, "b"): (2 / 3, 3), (2, "b"): (0.5, 3), (2, "c"): (0.5, 1)}


def test_cost_sums_tokens_and_dollars_in_one_aggregate(spark):
    from quillstone.functions import constants as K
    from quillstone.operators import scores as R

    model, (a, b) = next(iter(K.MODEL_PRICES.items()))
    rows = [(1, model, 1_000_000, 2_000_000), (1, "unknown", 3, 1_000_000), (2, model, 0, 1)]
    out = R.cost(spark.createDataFrame(rows, "g long, model string, input_tokens long, output_tokens long"), ["g"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {r.g: (float(r.cost_usd), r.tokens) for r in out.collect()}
    dollars = float(a) + 2 * float(b) + (3 * float(K.DEFAULT_PRICE[0]) + 1_000_000 * float(K.DEFAULT_PRICE[1])) / 1_000_000
    assert got[1] == (pytest.approx(dollars, abs=1e-6), 4_000_003) and got[2][1] == 1
