import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import extendible


def brute(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    out = []
    for t, ids in same.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(documents, rows, parts=3, **kw):
    got = extendible.groups(documents(rows).repartition(parts), **kw)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_odd_rows(documents, odd):
    assert run(documents, odd) == brute(odd)


def test_empty_table(documents):
    assert run(documents, []) == []


def random_rows(n, seed=3):
    rng = random.Random(seed)
    texts = [rng.choice("abcé ") * rng.randrange(1, 60) + str(rng.randrange(n // 4)) for _ in range(n)]
    return [(i, "hot text" if i % 3 == 0 else texts[i]) for i in range(n)]


@pytest.mark.parametrize("hashed", ["7L", "xxhash64(_text) & (3L << 60)", "-1L", "xxhash64(_text)"])
def test_any_hash_gives_the_same_groups(documents, hashed):
    """One hash for all, four hashes and the real one: chains compare bytes, so results agree."""
    rows = random_rows(400)
    assert run(documents, rows, hashed=F.expr(hashed)) == brute(rows)


def test_directory_doubles_and_owners_split(documents, monkeypatch):
    monkeypatch.setattr(extendible, "PAGE_BYTES", 500)
    monkeypatch.setattr(extendible, "BUCKET_BYTES", 400)
    monkeypatch.setattr(extendible, "OWNER_BYTES", 1500)
    rows = random_rows(600, 9)
    assert run(documents, rows) == brute(rows)


def test_directory_covers_every_slot_once(spark, monkeypatch):
    monkeypatch.setattr(extendible, "BUCKET_BYTES", 100)
    rng = random.Random(1)
    # a crowd under one prefix needs depth; the rest does not
    crowd = [(5 << 58) + rng.randrange(1 << 57) for _ in range(64)]
    keys = [(h - (1 << 64) if h >> 63 else h, 10) for h in [*crowd, *(rng.randrange(1 << 64) for _ in range(64))]]
    slots, depth = extendible.directory(spark.createDataFrame(keys, "h long, bytes long"), 1280)
    rows = slots.collect()
    at = [r.slot for r in rows]
    assert len(set(at)) == len(at) and depth > 4 and len({r.depth for r in rows}) > 2
    load = defaultdict(int)
    prefix = {r.slot: (r.prefix, r.depth) for r in rows}
    for h, b in keys:
        p, d = prefix[(h % (1 << 64)) >> (64 - depth)]
        assert p == (h % (1 << 64)) >> (64 - d)
        load[p, d] += b
    assert max(load.values()) <= 100


def test_copies_fold_in_the_page(documents):
    """A third of the rows is one text; it is an entry once per task, not once per row."""
    pages = extendible.write_pages(documents(random_rows(300)).coalesce(2), "doc_id", "text", F.xxhash64("_text"))
    assert pages.filter("entry = row and text = 'hot text'").count() <= 2
    assert pages.filter("entry <> row and text is not null").count() == 0
