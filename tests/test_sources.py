"""Files in, files out."""

import json
from hashlib import sha256

from pyspark.sql import functions as F

from quillstone.operators import cleaning, coverage, incremental, publish, responses, sections, trees
from quillstone.sources import files


def test_transcripts_with_unreadable_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "c.pdf").write_text("skipped")
    rows = {r.filename: r for r in files.read_transcripts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.md"}
    assert rows["a.txt"].word_count == 3 and rows["a.txt"].error is None
    assert rows["b.md"].content == "" and rows["b.md"].error
    assert files.non_empty(files.read_transcripts(spark, str(tmp_path))).count() == 1


def test_artifacts_drop_unknown_fields(spark, tmp_path):
    p = tmp_path / "atoms.json"
    p.write_text(json.dumps({"atoms": [{"id": "atom_0001", "title": "T", "odd": 1}], "total_atoms": 1, "score": 9.5}, indent=2))
    rows = files.read_atoms(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0].id == "atom_0001" and "odd" not in rows[0].asDict()


def test_baseline_folder_is_ordered(spark, tmp_path):
    refs = tmp_path / "references"
    refs.mkdir()
    for n in ("b.md", "a.md", "c.md"):
        (refs / n).write_text(n)
    got = {r.filename: r.ref_idx for r in files.read_baseline_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": 0, "b.md": 1, "c.md": 2}


def test_tree_classification_and_profile(spark):
    paths = ["README.md", "docs/readme.txt", "docs/guide.md", "src/main.py", "src/util.go", "tests/test_x.py", "setup.py",
             "node_modules/a.js", "yarn.lock", "notes.txt"]
    df = spark.createDataFrame([("r", p, 2500) for p in paths], "repo string, path string, size long")
    c = trees.classify(df, "repo", "path").cache()
    kinds = {r.path: r.kind for r in c.collect()}
    assert kinds == {"README.md": "readme", "docs/readme.txt": "other", "docs/guide.md": "doc", "src/main.py": "source", "src/util.go": "source",
                     "tests/test_x.py": "test", "setup.py": "config", "notes.txt": "other"}
    top = trees.top_sources(c, "repo", "path", "size").orderBy("rank").first()
    assert top.path == "src/main.py" and top.score == 100 + 45 + 2
    p = trees.profile(c, "repo", "path").first()
    assert p.total_files == 8 and p.has_tests and p.has_docs and p.primary_language == "python" and p.config_files == ["setup.py"]


PAGE = """<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><main><p>Intro text that is long enough to stay in the
 table as a section.</p><h1>First</h1><p>Body of the first section, also long enough to stay around.</p><h2>Second</h2><ul><li>one <b>bold</b></li>
<li>two</li></ul><table><tr><th>a|b</th></tr><tr><td>c</td></tr></table><p>Body of the second section, again long enough to stay.</p></main></body></html>"""


def test_html_sections_and_markdown(spark):
    df = spark.createDataFrame([(1, "https://x.org/p", PAGE)], "page_id long, url string, html string")
    rows = sections.html_sections(df, "page_id", "url", "html").orderBy("section").collect()
    assert [r.title for r in rows] == ["Introduction", "First", "Second"]
    assert rows[2].section_path == ["First", "Second"] and rows[1].entry_id.startswith("bl_")
    md = sections.html_to_markdown(df, "page_id", "html").first().markdown
    assert "# First" in md and "- one  **bold**" in md and "| a\\|b |\n| --- |\n| c |" in md and "menu" not in md


def test_response_repair(spark):
    texts = ['```json\n{"a": [1]}\n```', 'so: {"a": [2]} ok', '{"a": [3, 4', '{"a": [5], "b": "cut', "nothing", '{"b": "x\\"y', '{"a": [6],']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r for r in responses.ingest(df, "t", "a array<int>, b string").collect()}
    assert [rows[i].parse_status for i in range(7)] == ["parsed", "extracted", "repaired", "repaired", "quarantined", "repaired", "repaired"]
    assert rows[2].parsed.a == [3, 4] and rows[3].parsed.b == "cut" and rows[5].parsed.b == 'x"y' and rows[6].parsed.a == [6]


def test_write_phase_partitions_by_build(spark, tmp_path):
    df = spark.createDataFrame([("b1", "x"), ("b2", "y")], "build_id string, id string")
    files.write_phase(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "build_id=b1").exists() and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scraped_pages_one_document_a_file_or_a_line(spark, tmp_path):
    page = {"url": "https://x.org", "title": "T", "content": "c", "headings": [{"level": "2", "text": "h", "id": ""}], "links": ["/a", "/b"], "odd": 1}
    (tmp_path / "one.json").write_text(json.dumps(page, indent=2))
    read = files.read_scraped_pages(spark, str(tmp_path / "one.json"))
    assert read.first().links == ["/a", "/b"] and read.first().headings[0].level == "2"
    files.write_scraped_pages(read.withColumn("more", F.lit(1)).unionAll(read.withColumn("more", F.lit(2))), str(tmp_path / "out"))
    back = files.read_scraped_pages(spark, str(tmp_path / "out"), lines=True)
    assert back.collect() == [read.first()] * 2


def test_tree_reader_and_baseline_summary(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "README.md").write_text("hello")
    rows = {r.path: (r.size, r.content) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {"src/a.py": (5, "x = 1"), "README.md": (5, "hello")}
    (tmp_path / "summary.json").write_text(json.dumps({"source": "nowhere", "references": [], "odd": 2}, indent=1))
    assert files.read_baseline_summary(spark, str(tmp_path / "summary.json")).first().source == "nowhere"
    assert files.admitted(files.read_baseline_summary(spark, str(tmp_path / "summary.json"))).count() == 0


def test_clean_summary_names_what_was_removed(spark):
    df = spark.createDataFrame([("a\n\n\n\n\nb   \n12\n",), ("plain",)], "raw string")
    said = [r.s for r in cleaning.clean(df, "raw", "content").select(cleaning.clean_summary(F.col("clean_stats")).alias("s")).collect()]
    assert said[0].startswith("Cleaned: removed ") and said[1] == "Clean: no noise detected"


def test_set_keys_tell_sets_apart_that_sums_do_not(spark, monkeypatch):
    monkeypatch.setattr(incremental, "SET_BLOCK", 3)
    a, b = "00000001" + "00000002", "00000003" + "00000004"
    c, d = "00000002" + "00000001", "00000002" + "00000005"  # the same sums of both parts
    sets = {"x": [a, b], "y": [b, a], "z": [c, d], "v": [a, b, b], "w": [f"{i:016x}" for i in range(40)], "u": [f"{i:016x}" for i in reversed(range(40))],
            "t": [f"{i:016x}" for i in range(39)] + ["f" * 16]}
    rows = [(k, h, i) for k, hs in sets.items() for i, h in enumerate(hs)]
    keys = {r.d: (r.n, r.set_key) for r in incremental.file_set_key(spark.createDataFrame(rows, "d string, h string, i long").withColumn("d0", F.col("d")), "d", "h", "i", "m", "t").collect()}
    assert {k: n for k, (n, _) in keys.items()} == {k: len(h) for k, h in sets.items()}
    # the domain is part of the key, so sets are compared under one name
    one = {}
    for name in "xyzvwut":
        rows = [("d", h, i) for i, h in enumerate(sets[name])]
        one[name] = incremental.file_set_key(spark.createDataFrame(rows, "d string, h string, i long"), "d", "h", "i", "m", "t").first().set_key
    assert one["x"] == one["y"] and one["w"] == one["u"]
    assert len({one[n] for n in "xzvwt"}) == 5


def test_set_key_is_the_digest_of_all_hashes_in_a_row(spark, monkeypatch):
    """sets longer than a block had a key of their own kind."""
    monkeypatch.setattr(incremental, "SET_BLOCK", 3)
    hashes = {"d": [f"{i * 7919 % 101:016x}" for i in range(40)], "e": ["aa"], "n": [None, "bb", None], "o": [None], None: ["cc", "dd"]}
    rows = [(k, h, i) for k, hs in hashes.items() for i, h in enumerate(hs)]
    got = incremental.file_set_key(spark.createDataFrame(rows, "d string, h string, i long"), "d", "h", "i", "m", "t").collect()
    want = {k: sha256(":".join([*([k] if k else []), *sorted(h for h in hs if h), "m", "t"]).encode()).hexdigest()[:16] for k, hs in hashes.items()}
    assert {r.d: r.set_key for r in got} == want and {r.d: r.n for r in got} == {k: len(hs) for k, hs in hashes.items()}


def test_word_tokens_of_a_summary_do_not_depend_on_the_order(spark):
    """thirty times 1.3 adds up to less than 39."""
    refs = spark.createDataFrame([("s", i, "word") for i in range(30)], "source string, doc_id long, text string").coalesce(1)
    assert coverage.baseline_summary(refs, "source", "doc_id", "text", F.lit(True)).first().word_tokens == 39


def test_vectors_are_made_once_per_text(spark, tmp_path):
    path, now = str(tmp_path / "vectors"), F.lit("2024-01-31").cast("timestamp")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    hits, misses = incremental.split_vectors(texts, "text", "m", incremental.read_vectors(spark, path), now)
    assert hits.count() == 0 and sorted(r.text for r in misses.collect()) == ["", "a", "b"]
    incremental.append_vectors(misses.filter("text <> 'b'").withColumn("vector", F.array(F.lit(1.0), F.lit(2.0))), "m", path, now)
    hits, misses = incremental.split_vectors(texts, "text", "m", incremental.read_vectors(spark, path), now)
    assert sorted(r.id for r in hits.collect()) == [1, 3, 4, 5] and [r.text for r in misses.collect()] == ["b"]
    for model, later in (("other", "2024-01-31"), ("m", "2024-04-01")):  # another model, or too long ago
        assert incremental.split_vectors(texts, "text", model, incremental.read_vectors(spark, path), F.lit(later).cast("timestamp"))[0].count() == 0


def test_examples_take_what_the_references_leave(spark):
    knowledge = spark.createDataFrame([("k" * 99,)], "text string")
    refs = spark.createDataFrame([(1, "r" * 500), (2, "s" * 500)], "ord long, text string")
    examples = spark.createDataFrame([(1, "x" * 900), (2, ""), (3, "y" * 900)], "ord long, text string")

    def parts(limit):
        return sorted((r.part, r.ord, len(r.text), r.is_cut) for r in publish.inline_document(knowledge, refs, examples, "ord", "text", 0, limit).collect())

    assert parts(10_000) == [("example", 1, 900, False), ("example", 3, 900, False), ("reference", 1, 500, False), ("reference", 2, 500, False)]
    assert parts(2_900) == [("example", 1, 900, False), ("example", 3, 696, True), ("reference", 1, 500, False), ("reference", 2, 500, False)]
    assert parts(2_000) == [("reference", 1, 500, False), ("reference", 2, 500, False)]  # under 1,000 characters of room
    assert parts(1_000) == [("reference", 1, 500, False), ("reference", 2, 198, True)]
