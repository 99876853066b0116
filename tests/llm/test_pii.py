import hashlib
import random
import re

from pyspark.sql import functions as F

from quillstone.llm import pii


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def count(s):
    return len(re.sub("[^0-9]", "", s))


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count(s) <= 15),
}


def base(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in PLAIN.items()}


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in spans[k])


def test_base_spans_agree_with_plain_expressions(spark, documents, odd):
    rng = random.Random(8)
    bits = [*"019.-+ @()_%a🎉é\n", "1.2.3.4", "a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (058) 555-8658", "255", "256", "0001"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 18)))) for i in range(600)]
    rows += [(1000 + n, t) for n, (_, t) in enumerate(odd)]
    rows += [(2000, "1" * 30_000), (2001, "a." * 20_000), (2002, "x@y.zz " * 3_000), (2003, "+1 " + "2 " * 20_000)]
    got = pii.find(documents([(i, t) for i, t in rows])).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        spans = base(of[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in PLAIN], of[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert set(joined(spans).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.find(documents([])).count() == 0


def context_rows():
    """Cards and other texts in the same context; the last rows' numbers fail every base test."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220"]
    rows = [(i, f"please charge card number {c} today, thanks") for i, c in enumerate(cards)]
    rows += [(20 + i, f"the year was {y} then") for i, y in enumerate((1984, 1999, 2011))]
    return rows, [(50, "please charge card number 4111111111111112 today, thanks"), (51, "the part number is 4111111111111113 here")]


def test_contexts_find_what_no_expression_knows(spark, documents):
    known, new = context_rows()
    got = {r.doc_id: r for r in pii.find(documents(known + new)).collect()}
    text = dict(new)[50]
    at = text.index("4111")
    assert got[50].n_card == 0 and got[50].spans == f"card:{at}:{at + 16}"
    assert got[51].spans == "" and got[20].spans == ""


def test_rounds_raise_trust_of_linked_patterns(spark, documents):
    known, new = context_rows()
    from pyspark.sql import functions as F

    found = pii.mentions(documents(known + new), F.coalesce("text", F.lit("")))
    patterns, instances = pii.bootstrap(found)
    trust = {r.pattern: r.trust for r in patterns.collect()}
    assert all(0 <= t < 1 for t in trust.values()) and max(trust.values()) >= pii.CONFIDENT
    assert {r.core for r in instances.filter("trust > 0.5").collect()} == {"4111111111111112"}


def test_contexts_find_other_forms_than_their_seeds(spark, documents):
    phones = ["+49 30 1234567", "+1 (058) 555-8658", "+44 20 7946 0958", "+33 1 23 45 67 89", "+41 44 668 18 00"]
    cards = ["4111111111111111", "5500 0055 5555 5559", "4012888888881881", "5105-1051-0510-5100", "4222222222220000006"]
    rows = [(i, f"you can ring me under {p} until evening") for i, p in enumerate(phones)]
    rows += [(10 + i, f"please charge card number {c} today, thanks") for i, c in enumerate(cards)]
    rows += [(20 + i, f"{n} boxes were sent under order {n} last week") for i, n in enumerate(range(1000, 1040))]
    rows += [(70 + i, f"we sent order {c} twice") for i, c in enumerate(cards)]
    new = [(100, "you can ring me under 030/7654321 until evening", "phone", "030/7654321"), (101, "please charge card number ACC-7731-99X today, thanks", "card", "ACC-7731-99X")]
    got = {r.doc_id: r.spans for r in pii.find(documents(rows + [n[:2] for n in new])).collect()}
    for i, text, kind, of in new:
        assert got[i] == f"{kind}:{text.index(of)}:{text.index(of) + len(of)}"
    assert all(got[20 + i] == "" for i in range(40))  # five seeds among forty plain numbers carry nothing


def test_emails_are_seeds_and_are_found(spark, documents):
    from pyspark.sql import functions as F

    rows = [(i, f"write a mail to {n}@mail{i % 3}.example.com before noon") for i, n in enumerate(("ann", "bob", "cyd", "dee", "eve"))]
    rows += [(20 + i, f"the box went to {n} shops on monday") for i, n in enumerate((1, 2, 3))]
    docs = documents(rows + [(50, "write a mail to jane.roe@intranet before noon")])
    seen = pii.mentions(docs, F.coalesce("text", F.lit("")))
    patterns, _ = pii.bootstrap(seen)
    assert seen.filter("kind = 'email'").count() == 5
    assert {"LL mail to", "LR to _ before"} <= {r.pattern for r in patterns.filter("kind = 'email' and seeds = 5").collect()}
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert got[50] == "email:16:33" and all(got[20 + i] == "" for i in range(3))


def test_redaction(spark, documents, odd):
    known, new = context_rows()
    rows = [*odd, *known, *new, (60, "mail a.b@c.de, ip 10.0.0.1; call +49 (30) 1234-5678 ok"), (60, "mail a.b@c.de, ip 10.0.0.1; call +49 (30) 1234-5678 ok")]
    docs = documents([(100 + (i or 0) if n < len(odd) else i, t) for n, (i, t) in enumerate(rows)])
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 60] == ["mail [EMAIL], ip [IP]; call [PHONE] ok"] * 2
    assert next(r.text for r in got if r.doc_id == 50) == "please charge card number [CARD] today, thanks"
    assert next(r.text for r in got if r.doc_id == 101) is None
    same = {t for _, t in odd}
    assert all(r.text in same for r in got if r.doc_id >= 100)
    assert pii.redact(documents([])).count() == 0


def test_main_path_has_no_python(spark, documents, odd):
    plan = pii.find(documents(odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_mention_takes_its_context_and_not_all_gaps_along(spark):
    """the search starts at a digit or ``@``, and what is dealt out per mention is bounded whatever its text holds."""
    text = "word " * 400 + "tel.\tno.x7 8b  q9 and " + "w" * 200 + "5 end @x"
    df = spark.createDataFrame([(text,)], ["text"])
    made = pii.mentions(df, F.col("text"))
    got = {r.core: (text[r.start:r.end], r.patterns) for r in made.collect()}
    assert {core: found for core, (found, _) in got.items()} == {c: c for c in ("no.x7 8b", "q9", "w" * 200 + "5", "@x")}
    assert got["no.x7 8b"][1] == ["L tel.", "LL word tel.", "LR tel. _ "] and got["q9"][1][2] == "LR  _ and" and got["@x"][1][2] == "LR end _ "
    plan = made._jdf.queryExecution().executedPlan().toString()
    carried = [re.search(r"\), \[([^\]]*)\], false, \[", line) for line in plan.splitlines() if "Generate " in line]
    assert carried and all(c and c.group(1).startswith("text_key#") and "," not in c.group(1) for c in carried)
