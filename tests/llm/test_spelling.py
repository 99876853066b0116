import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillstone.llm import spelling
from quillstone.llm.spelling import Acceptor, partition_pairs

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def run(documents, rows):
    got = spelling.variants(documents(rows).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def test_odd_rows(documents, odd):
    rows = [*odd, (10, "Überlänge überlänge ÜBERLÄNGE überlängen überlängen ×÷×÷×÷×÷ ×÷×÷×÷×÷"), (None, "wordless wordless"), (12, "y" * 50_000 + " " + "y" * 50_000)]
    assert run(documents, rows) == brute(rows)


def test_empty_table(documents):
    assert run(documents, []) == []


def chain_rows():
    """Counts a factor of ten and more apart, so that forms have forms."""
    words = {"abcdefgh": 5000, "abcdefgx": 300, "abcdefyx": 25, "abcdezyx": 2, "bbcdefgh": 150, "abcdefghi": 150, "zzabcdefgh": 3}
    return [(0, " ".join(w for w, n in words.items() for _ in range(n)))]


def test_forms_are_followed_to_the_root(documents, monkeypatch):
    rows = chain_rows()
    got = run(documents, rows)
    assert got == brute(rows)
    assert {w: r for w, _, r, *_ in got}["abcdezyx"] == "abcdefgh"


def random_rows(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabcé") for _ in range(rng.randrange(7, 10))) for _ in range(40)]

    def typo(w):
        at, c = rng.randrange(len(w) + 1), rng.choice("abcéz")
        return rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])

    return [(i, " ".join(typo(w) if rng.random() < 0.3 else w for w in rng.choices(base, weights=range(1, 41), k=60))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(documents, seed):
    rows = random_rows(120, seed)
    assert run(documents, rows) == brute(rows)


def test_acceptor_is_minimal_and_exact():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    machine = Acceptor(words)
    held, todo = [], [(0, "")]
    while todo:
        q, s = todo.pop()
        held += [s] * machine.final[q]
        todo += [(r, s + c) for c, r in machine.arcs[q].items()]
    assert sorted(held) == words
    # states that are reached have different right languages
    reached, todo = set(), [0]
    while todo:
        q = todo.pop()
        if q not in reached:
            reached.add(q)
            todo += machine.arcs[q].values()
    assert len({frozenset(machine.common(q, q)) for q in reached}) == len(reached)


def test_composition_gives_each_pair_once():
    rng = random.Random(8)
    for _ in range(30):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(25)})
        got = list(Acceptor(words).one_edit())
        want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_partitions_split_the_pairs():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(900)})
    parts = defaultdict(list)
    for w in words:
        for m in {len(w), len(w) - 1} - {6}:
            parts[m, False, w[: m // 2]].append(w)
            parts[m, True, w[len(w) - (m - m // 2) :]].append(w)
    got = [frozenset(p) for key, ws in parts.items() for p in partition_pairs(*key, ws)]
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(want) and set(got) == want
