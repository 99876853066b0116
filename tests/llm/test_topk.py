import math
import random

import numpy as np

from quillstone.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, q int, score double"


def brute(rows, k):
    sound, seen = [], set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(64 * float(np.float32(x))) for x in v)
        if (i, q) not in seen:
            seen.add((i, q))
            sound.append((i, q))
    want = []
    for i, q in sound:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, o)), j) for j, o in sound if j != i)[:k]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(want)


def run(spark, rows, k=20):
    frame = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA)
    vectors = topk.quantised(frame)
    got = topk.search(vectors, vectors.filter("vec_id % 20 = 0"), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    near = rng.normal(size=16)
    rows = [(i, (near + rng.normal(size=16) * (0.2 if i % 3 else 2)).tolist()) for i in range(500)]
    rows += [(500 + i, near.tolist()) for i in range(90)]  # ties over several blocks
    assert run(spark, rows) == brute(rows, 20)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(15)]
    rows += [
        (20, None), (40, []), (60, [1.0, None, 0.0, 0.0]), (80, [float("nan")] * 4), (100, [float("inf"), 0.0, 0.0, 0.0]),
        (120, [0.5, -0.5]), (140, [0.25] * 6), (None, [1.0] * 4), (3, rows[3][1]), (3, [9.0] * 4), (160, [30_000.0] * 4), (180, [0.0] * 4),
    ]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, [(0, [1e30]), (1, [1.0])]) == []  # a component beyond the exact range: the vector takes no part
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_reading_stops_only_on_proof():
    """Whatever is read before stopping, the result is that of all postings."""
    rng = np.random.default_rng(3)
    block = rng.integers(-40, 40, (300, 12)).astype(np.int32)
    block[:40] += 60
    queries = np.concatenate([block[:3], rng.integers(-40, 40, (4, 12))]).astype(np.int32)
    ids = rng.permutation(300).astype(np.int64)
    q_ids = np.concatenate([ids[:3], [1000, 1001, 1002, 1003]])
    i, j, s = topk.best(queries, q_ids, ids, 12, *topk.postings(block), 10)
    for q in range(len(queries)):
        want = sorted((-int(x), int(v)) for x, v in zip(block.astype(np.int64) @ queries[q], ids) if v != q_ids[q])[:10]
        assert [(-int(a), int(ids[b])) for a, b in zip(s[i == q], j[i == q])] == want


def test_postings_come_by_descending_impact():
    block = np.array([[3, 0, -50], [7, 1, 2]], np.int32)
    dim, local, value, ends = topk.postings(block)
    back = np.zeros_like(block)
    back[local, dim] = value
    assert (back == block).all() and ends[-1] == 5
    for a, b in zip([0, *ends], ends):
        assert b == len(value) or not b or min(abs(value[a:b]), default=99) >= max(abs(value[b:]))
