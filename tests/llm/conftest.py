import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and word again, " * 30_000

#: Nulls in every column, an empty and a very long text, ties and repeated rows.
EDGES = [
    (1, "the cat sat on the mat and then the cat sat on the mat again today", "en", "a", 10),
    (1, "the cat sat on the mat and then the cat sat on the mat again today", "en", "a", 10),
    (2, "the cat sat on the mat and then the cat sat on the mat again today", "en", "b", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "", "en", None, 0),
    (None, "a text without an id of its own but with words enough", "en", "b", 5),
    (6, LONG, "en", "a", len(LONG)),
    (7, "täxt \U0001f600 with \x1c odd\x00 things < > \\ <s>", "de", "b", 9),
    (8, "    \n\t ", "fr", "c", 7),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
