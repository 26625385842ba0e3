import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, blank lines, a very long text, repeated rows, equal texts under other ids, odd characters.
LONG = "the quick brown fox. " * 4000 + "\n" + "x" * 50_000
ODD = [(1, None), (2, ""), (3, "\n \n\t\n"), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"),
       (6, "one two three four five six"), (7, "word"), (8, "ein\x00wort 🙂 ﬁ İstanbul \x1c\x85"), (None, "one two three four five six"),
       (None, None), (9, "One two three four five six\nA common line of text\nsame same"),
       (10, "  a COMMON line of text\t\nother words here\nsame same")]


@pytest.fixture(scope="session")
def make(spark):
    """A function from (doc_id, text) pairs to a table with the columns of documents and some that clash."""
    def docs(pairs, clash=False):
        rows = [(i, t, "en" if k % 3 else None, "s", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            for name in ("rid", "key", "bits", "n", "h", "pos", "c", "g", "root", "hit_id", "c0", "piece_ids"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return docs
