import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of ``[(doc_id, text)]``, with columns whose names the operators use themselves."""

    def build(rows, partitions=3):
        rows = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        clash = ("kept", "length", "chunk", "spans", "score", "content", "slot", "component_id", "n_words", "hash", "keep_id")
        return df.selectExpr("*", *[f"'x' AS {name}" for name in clash])

    return build


@pytest.fixture(scope="session")
def fixture_rows():
    """Documents of the small test table, whole."""
    path = "/root/testdata/sf0.001/documents.parquet"
    return duckdb.sql(f"SELECT doc_id, text FROM '{path}' ORDER BY doc_id").fetchall()


# Awkward texts every operator has to take: null, empty, blank, one word, controls,
# letters outside the first plane, special tokens, long words and long texts.
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "word",
    "a\x00b \x1c\x1d x\x85y z    ",
    "ΑΣ Σ ὈΔΥΣΣΕΎΣ İstanbul ǅ ß ẞ ﬁ Å é ²³ ½ ٣ १२ 漢字かな 😀👩‍👩‍👧",
    "<|endoftext|> x<|startoftext|>y <|endoftext|><|endoftext|> <|other|>",
    "it's we're I'll they'd I've 'tis don''t 's's",
    "a" * 3000,
    "ab" * 2000 + " " + "7" * 500 + " " * 300 + "\n" * 50 + "!?" * 400,
    "long words " * 4000,
    "x_y __init__ snake_case_1 a1b2c3 3.14 1,000 $5 100% C++ #tag @me",
]


@pytest.fixture(scope="session")
def odd_rows():
    return list(enumerate(ODD_TEXTS))
