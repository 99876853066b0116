import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillstone.llm import byte_bpe, token_counts
from quillstone.session import shared_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_agrees_with_tiktoken(reference):
    bpe = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    rng = random.Random(5)
    letters = [*" \n\t\r\x1c\x85 　'asdfé日1٣!.", "'ll", " the", "ing", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, bpe.encode_many(texts), strict=True):
        assert ids == reference.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_every_token_decodes_to_its_bytes():
    bpe = byte_bpe.codec(RANKS, P.PATTERN)
    assert all(bpe.bytes_of[i] == token for token, i in bpe.ranks.items())


def test_byte_bpe_digests_of_odd_rows(spark, documents, odd, reference):
    got = byte_bpe.digests(documents(odd), RANKS, P.PATTERN).collect()
    want = []
    for i, text in odd:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.digests(documents([]), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_columns_round_trip(spark, documents, odd):
    ids = byte_bpe.encode(documents(odd), RANKS, P.PATTERN, keep=("doc_id", "text"))
    back = byte_bpe.decode(ids, RANKS, P.PATTERN, keep=("doc_id", "text")).collect()
    assert len(back) == len(odd) and all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_token_counts_fill_and_use_the_cache(spark, documents, odd, monkeypatch):
    cache = f"{shared_dir(spark)}/llm-test/cache-{random.random()}"
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = sorted(
        (str(i), len((t or "").encode()), n, n > 2048) for i, t in odd for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)]
    )

    def run(rows):
        got = token_counts.count_tokens(documents(rows), WORD_FILE, cache).collect()
        return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got)

    assert run(odd) == want
    stored = token_counts.read_cache(spark, cache)
    different = len({" ".join((t or "").split()) for _, t in odd})
    assert stored.count() == stored.select("content_digest").distinct().count() <= different + 2
    n = stored.count()
    assert run(odd) == want and token_counts.read_cache(spark, cache).count() == n  # all were hits
    run([*odd, (10, "a text that is new")])
    assert token_counts.read_cache(spark, cache).count() == n + 1
    assert run([]) == []


def test_cache_is_kept_apart_by_version(spark, documents, monkeypatch):
    cache = f"{shared_dir(spark)}/llm-test/cache-{random.random()}"
    token_counts.count_tokens(documents([(1, "some words")]), WORD_FILE, cache).collect()
    monkeypatch.setattr(token_counts.tokenizers, "__version__", "0.0")
    token_counts.count_tokens(documents([(1, "some words")]), WORD_FILE, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == 2


def test_word_counter_agrees_with_the_library():
    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(WORD_FILE)
    letters = [*" \n\t\x0b\x0c\r\x1c ́'AaÉé日1!.Σς", "<|endoftext|>", "'LL", "İ"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(3000)]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(WORD_FILE).count_many(texts) == want
