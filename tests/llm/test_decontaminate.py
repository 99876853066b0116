import random

import numpy as np

from quillstone.llm import decontaminate as d


def plain_tiling(doc, item, least):
    """Greedy tiling by looking at every pair of places."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        free_d[i : i + n] = [False] * n
        free_i[j : j + n] = [False] * n
        covered += n


def test_tiling_agrees_with_the_plain_one():
    rng = random.Random(11)
    for _ in range(150):
        doc = rng.choices(range(6), k=rng.randint(0, 40))
        item = rng.choices(range(6), k=rng.randint(0, 25))
        tiles = d.tile([np.array(doc, np.uint64)], np.array(item, np.uint64), 3)
        assert sum(t[2] for t in tiles) == plain_tiling(doc, item, 3)
        spots = [p for _, j, n in tiles for p in range(j, j + n)]
        assert len(spots) == len(set(spots))


ITEM = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at dusk"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, words long, seed string")


def test_copies_reordered_and_partial_passages(spark, documents):
    words = ITEM.split()
    moved = " ".join(words[10:]) + " and then again " + " ".join(words[:10])
    docs = documents([
        (1, "intro " + ITEM.upper() + "! outro"), (2, moved), (3, " ".join(words[:8]) + " stops here"), (4, "nothing of it at all"),
        (5, " ".join(words[i] for i in range(0, len(words), 2))), (6, ITEM), (6, ITEM), (7, ITEM + " " + ITEM),
    ])
    rows = d.leaks(docs, bench(spark, [(10, ITEM, 0, ""), (11, "too few words", 0, ""), (12, None, 0, ""), (13, "", 0, "")])).collect()
    got = sorted((r.doc_id, r.item_id, r.matched) for r in rows)
    n = len(words)
    assert got == [(1, 10, n), (2, 10, n), (6, 10, n), (6, 10, n), (7, 10, n)]
    assert {r.doc_id: r.n_tiles for r in rows}[2] == 2
    kept = d.clean(docs, bench(spark, [(10, ITEM, 0, "")]))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_words_of_overlapping_seeds_count_once(spark, documents):
    """Two matches that share two words of the document: only one of them can be a tile."""
    row = d.overlaps(documents([(1, "a b c d e f g h")]), bench(spark, [(1, "a b c d e x y d e f g h", 0, "")])).collect()
    assert [(r.matched, r.item_words) for r in row] == [(5, 12)]
    assert d.leaks(documents([(1, "a b c d e f g h")]), bench(spark, [(1, "a b c d e x y d e f g h", 0, "")])).count() == 0


def test_seeds_one_to_four_words_apart(spark, documents):
    rng = random.Random(17)
    text = [f"w{i}" for i in range(24)]
    items, docs = [], [(0, " ".join(text))]
    for j in range(40):  # an item is made of pieces of the document that overlap by one to four words
        at, parts = rng.randrange(6), []
        while at + 5 <= len(text):
            end = min(len(text), at + rng.randint(5, 7))
            parts.append(" ".join(text[at:end]))
            at = end - rng.randint(1, 4)
        items.append((j, f" gap{j} ".join(parts)))
    got = {r.item_id: r.matched for r in d.overlaps(documents(docs), bench(spark, [(j, t, 0, "") for j, t in items])).collect()}
    assert got == {j: plain_tiling(text, t.split(), d.MIN_MATCH) for j, t in items}


def test_odd_rows_and_empty_tables(spark, documents, odd):
    docs = documents(odd)
    none = bench(spark, [])
    assert d.leaks(docs, none).count() == 0 and d.clean(docs, none).count() == len(odd)
    items = bench(spark, [(None, odd[3][1], 0, ""), (1, odd[3][1], 0, ""), (1, odd[3][1], 0, "")])
    rows = d.leaks(docs, items).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in rows) == sorted((str(i), j) for i in (4, 4, None) for j in ("None", "1"))
    assert d.clean(docs, items).count() == len(odd) - 3
    assert d.leaks(documents([]), items).count() == 0


def test_random_documents_against_the_plain_tiling(spark, documents):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 14)))) for i in range(6)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"x y {t} z") for i, t in items]
    want = set()
    for i, t in docs:
        for j, u in items:
            a, b = t.split(), u.split()
            covered = plain_tiling(a, b, d.MIN_MATCH)
            if covered >= d.THRESHOLD * len(b):
                want.add((i, j, covered))
    rows = d.leaks(documents(docs), bench(spark, [(j, u, 0, "") for j, u in items])).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in rows} == want
