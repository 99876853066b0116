import random
from zlib import crc32

import numpy as np
import pytest

from quillstone.llm import quality, subword, toxicity

SMALL = subword.Settings(buckets=1 << 12, dims=4, epochs=10, rate=0.3, scale=16.0)
RUDE = ["blockhead", "numbskull", "scoundrel"]


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9))) for _ in range(200)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=40)
        if i % 3 == 0:
            words[5:5] = rng.choices(RUDE, k=2)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return subword.fit(*corpus(600, 1), SMALL)


def test_held_out_texts_and_unseen_misspellings(model):
    scorer = subword.Scorer(model)
    texts, labels = corpus(300, 9)
    right = [(scorer.score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels)]
    assert np.mean(right) > 0.95
    clean = next(t for t, y in zip(texts, labels) if not y)
    spelt = scorer.score(f"blokhead numbskulll {clean}")
    assert spelt > 0.5 > scorer.score(clean)


def test_scores_match_the_plain_average(model):
    """The memo of words gives what the definition gives."""
    scorer = subword.Scorer(model)
    for text in ("one two one", "a", "numbskull " * 7):
        words = text.lower().split()
        mean = sum(np.mean([scorer.value[s] for s in subword.subwords(w, SMALL)]) for w in words) / len(words)
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-(SMALL.scale * mean + model.bias))))


def test_shapes_of_windows():
    assert subword.shape_shares(np.array([1, 1, 1, 1])).tolist() == [1, 0, 0, 0, 0]
    assert subword.shape_shares(np.array([1, 2, 3])).tolist() == [0, 0, 0, 0, 1]
    assert subword.shape_shares(np.array([1, 2, 1])).tolist() == [0, 0, 1, 0, 0]
    assert subword.shape_shares(np.array([1, 2])).sum() == 0


def test_repetition_is_low_quality_with_unseen_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join([word()] * 30) if i % 2 else " ".join(word() for _ in range(30)) for i in range(400)]
    scorer = subword.Scorer(subword.fit(texts, [1 - i % 2 for i in range(400)], quality.SETTINGS))
    assert scorer.score("zzkrw " * 30) < 0.3 < scorer.score(" ".join(word() for _ in range(30)))


def test_one_label_gives_its_share_everywhere():
    model = subword.fit(["a", "b", "c"], [1, 1, 1], SMALL)
    scorer = subword.Scorer(model)
    assert scorer.score("") == scorer.score("anything") == pytest.approx(3.5 / 5)
    assert subword.Scorer(subword.fit([], [], SMALL)).score("x") == pytest.approx(0.25)


def test_sample_never_holds_held_out_rows(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    texts = subword.sample(docs, labels, "toxic", 1000).collect()
    learned = {int(r._text.split()[1]) for r in texts}
    assert learned == {i for i in range(200) if crc32(str(i).encode()) % 5}
    assert subword.sample(docs, labels, "toxic", 10).count() == 10


def test_odd_rows(spark, documents, odd, model):
    docs = documents(odd)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(odd)
    empty = subword.Scorer(model).score("")
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (None if r.doc_id is None else crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (1, 2, 3):
            assert r.score == empty
    assert quality.score(documents([]), model).count() == 0
    kept = toxicity.accept(documents([*odd, (20, " ".join(RUDE))]), model)
    assert kept.columns == docs.columns and 20 not in {r.doc_id for r in kept.collect()}
    assert kept.filter("doc_id = 4").count() in (0, 2)  # equal rows share their fate


def test_missing_labels(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(documents(odd), toxicity.train(documents(odd), none)).collect()
    assert {round(r.score, 6) for r in rows} == {0.25}
