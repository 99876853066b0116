import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillstone.llm import alignment
from quillstone.llm.byte_bpe import byte_letters

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Groups of (A ids, B ids) of a whole text by decoded bytes alone, or None."""
    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_letters())}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def cut(text):
        if not text:
            return None
        xs = [(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = [(i, b_bytes(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        if b"".join(t for _, t in xs) != raw or b"".join(t for _, t in ys) != raw:
            return None

        def by_end(tokens):
            at, out = 0, []
            for i, t in tokens:
                at += len(t)
                out.append((at, i))
            return out

        xs, ys = by_end(xs), by_end(ys)
        shared = sorted({e for e, _ in xs} & {e for e, _ in ys})
        groups = [([], []) for _ in shared]
        for side, tokens in enumerate((xs, ys)):
            for at, i in tokens:
                groups[bisect_left(shared, at)][side].append(i)
        return groups, shared

    return cut


def brute(plain, rows):
    cut = [(i, plain(t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, c in cut if c for g in c[0])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, c in cut:
        if not c:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, _ = c
        pairs = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs),
                    sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


ODDER = [(20, "a▁b"), (21, " "), (22, "   "), (23, "x "), (24, " x  y   z "), (25, "\n x\r\n\ty 　 z  w"), (26, "日本語🎉🎉 👩‍👩‍👧 é́ ﷽ \U0001f1e6\U0001f1e8"),
         (27, "def f():\r\n    return {}\r\n"), (28, "</s> <unk> <0x41> <|endoftext|>"), (29, "\x00\x01\x1c \x1f x"), (30, "ſﬁ Ⅷ ½ ｆｕｌｌ")]


def run(documents, rows):
    got = alignment.alignments(documents(rows).repartition(3), A_FILE, B_FILE)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def test_odd_rows(documents, odd, plain):
    rows = [*odd, *ODDER]
    assert run(documents, rows) == brute(plain, rows)


def test_empty_table(documents):
    assert run(documents, []) == []


def random_rows(n, seed):
    rng = random.Random(seed)
    letters = [*"  \n\t\r\x1c\x85 　'asdfé日1٣!.🎉ß", "'ll", " the", "ing", "<|endoftext|>", "{\r", " 日本", "́"]
    return [(i, "".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [1 << 16, 5])
def test_random_texts(documents, plain, monkeypatch, frequent):
    """Also with so few broadcast pairs that most links take the join."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = random_rows(400, 7)
    assert run(documents, rows) == brute(plain, rows)


def test_spans_are_the_cuts(documents, plain):
    rows = [*((i + 100, t) for i, t in random_rows(60, 3)), *ODDER]
    got = {r.doc_id: r for r in alignment.spans(documents(rows), A_FILE, B_FILE).collect()}
    for i, t in rows:
        want = plain(t)
        assert got[i].cuts == (want[1] if want else [])
        assert (got[i].groups == "") == (want is None)


def test_shared_spans_are_refined_by_bytes():
    def ends(spans, sizes):
        starts, stops = np.array(spans).T
        return alignment.ends(starts, stops, np.array(sizes)).tolist()

    # a token of its own, three parts of one character, a token of its own
    assert ends([(0, 2), (2, 6), (2, 6), (2, 6), (6, 7)], [2, 1, 2, 1, 1]) == [2, 3, 5, 6, 7]
    # fallback bytes: all but the last have an empty span
    assert ends([(0, 1), (1, 1), (1, 1), (1, 4), (4, 5)], [1, 1, 1, 1, 1]) == [1, 2, 3, 4, 5]
    # no span is of use
    assert ends([(0, 3), (0, 3), (0, 3)], [1, 1, 1]) == [1, 2, 3]
