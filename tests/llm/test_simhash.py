import random
import re

import numpy as np
import xxhash

from quillstone.llm import components, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, budget):
    """Class of each distinct value by looking at all pairs, as the smallest member."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints(odd):
    for _, text in odd[:4] + odd[6:7] + odd[8:]:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text)
    rng = random.Random(1)
    for n in range(12):
        text = " ".join(rng.choices(["Ab", "cÉ", "d e", "f\x1cg"], k=n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in (rng.getrandbits(64), 5, 1 << 63):  # dense groups, some at the sign bit
        for _ in range(150):
            v = centre
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = {v: int(np.uint64(v).astype(np.int64)) for v in values}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(3)
    for budget in (0, 1, 4, 7):
        want = reachable(sorted(values), budget)
        for cell in (8, 512):
            made = simhash.links(frame, budget, cell).collect()
            edges = {(r.a, r.b) for r in made}
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= budget for a, b in edges)
            got = {r.node: r.root for r in components.components(spark.createDataFrame(list(edges), "a long, b long")).collect()} if edges else {}
            classes = {}
            for v in values:
                classes.setdefault(got.get(signed[v], signed[v]), set()).add(v)
            expected = {}
            for v in values:
                expected.setdefault(want[v], set()).add(v)
            assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_large_group_keeps_only_spanning_links(spark):
    rng = random.Random(2)
    values = {sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(1500)}
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    n = simhash.links(frame, 4, 256).count()
    assert n < 60 * len(values)  # all pairs of this group would be over a thousand for each


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}


def test_classes_of_odd_rows(spark, documents, odd):
    got = simhash.classes(documents(odd)).collect()
    assert len(got) == len(odd)
    of = {(r.doc_id, r.text_key): r for r in got}
    by_id = {i: next(r for r in got if r.doc_id == i) for i, _ in odd}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1 and by_id[1].fp == 0
    assert by_id[4].component_id == by_id[None].component_id == 4 and len(of) <= len(odd)
    assert simhash.classes(documents([])).count() == 0


def test_keep_one_keeps_one_row_of_each_class(spark, documents, odd):
    docs = documents([*odd, (4, "quite another text under the same number")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len({plain_fingerprint(t) for _, t in odd}) + 1
    assert rows.count((4, odd[3][1])) == 1 and (4, "quite another text under the same number") in rows
    assert sum(t is None or not t.strip() for _, t in rows) == 1
    nobody = documents([(None, "no number here"), (None, "no number here"), (None, "nor here, in this one")])
    assert sorted(r.text for r in simhash.keep_one(nobody).collect()) == ["no number here", "nor here, in this one"]
    assert simhash.keep_one(documents([])).count() == 0
