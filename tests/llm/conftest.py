import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (id, text) pairs, with columns that clash with the operators' own names."""

    def make(rows, clash=True):
        extra = ", n_tokens long, _text string, score double, key string, row string, fp long" if clash else ""
        data = [(i, t, "en", "src", len(t or "")) + ((1, "x", 0.5, "k", "r", 3) if clash else ()) for i, t in rows]
        return spark.createDataFrame(data, DOCUMENT + extra)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Nulls, empty and blank texts, one very long text, repeated rows, ties.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven."), (4, "One two three four five six seven."),
    (None, "One two three four five six seven."), (5, "x" * 50_000), (6, " ".join(WORDS * 2_000)), (7, "Ünïcode 日本語 🎉 \x1c sep"),
    (8, "   two  spaces\r\n\r\nend "), (9, "<|endoftext|> it's 12345 don't"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
