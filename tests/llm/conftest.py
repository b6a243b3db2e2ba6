import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=""):
        """Documents from (doc_id, text[, source]) tuples, with extra columns of awkward names if wanted."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *[f"'{x}' AS {x}" for x in extra.split()])

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Null ids and texts, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "a b c\nd e"), (None, None),
            (4, " \n\t \n"), (5, long), (6, "Zoë  said \U0001f600 <|endoftext|> it's ok"), (1, "another text of id one"), (7, "x" * 5000)]
    return make_docs(rows, "ids decoded fp size key part node label row a b w k score words kept spans")


@pytest.fixture(scope="session")
def empty_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
