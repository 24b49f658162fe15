import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, __text string, kept int"

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, None, None, None, None, "x", "y", 1),
    (2, "", "en", "a", 0, "x", "y", 1),
    (3, " \n\t ", "en", "a", 4, None, None, None),
    (4, LONG, "en", "b", len(LONG), "x", "y", 1),
    (5, "Same text here. Released under the MIT License. token = \"abcdefabcdefabcdef\"", "en", "b", 70, "x", "y", 1),
    (5, "Same text here. Released under the MIT License. token = \"abcdefabcdefabcdef\"", "en", "b", 70, "x", "y", 1),
    (None, "no id at all, but text ▁ 漢字 ☃ \x00 end", "fr", "c", 10, "x", "y", 1),
    (6, "word " * 80 + "é" * 30, "fr", "c", 430, "x", "y", 1),
    (7, " ".join(f"w{i}" for i in range(400)), "fr", "c", 430, "x", "y", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
