import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with columns whose names clash with those the operators use."""

    def make(rows):
        full = [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]
        extra = ", fp long, part int, score double, held_out string, ids string, `a.b` int, mention string, key long, home long, before long"
        extra += ", __key long, __other string, __found int, __id int, __no int, __hash long, __mix long, __kept int"
        return spark.createDataFrame([(*r, 1, 2, 0.5, "x", "y", 3, "m", 7, 8, 9, 77, "o", 5, 6, 4, 33, 11, 12) for r in full], TEXT + extra)

    return make


#: Texts that every operator has to take: none, empty, blank, marks only, one word, a long one, copies, odd characters.
ODD = [None, "", " \n\t ", "!!! ...", "word", "two words", "ab " * 30_000, "word", "İ ß x\x1cy 漢字 😀 é.é", "<|endoftext|> don't It's", "a" * 5000]
