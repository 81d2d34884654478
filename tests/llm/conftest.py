import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column whose name clashes with those that operators add.
EXTRA = ["size", "rank", "chunk", "run", "score", "part", "words", "rep", "component", "target"]

EN = "the cat and the dog sat on the mat while it was raining in the town of old stones"
DE = "der hund und die katze sind auf dem weg nach hause weil es in der stadt regnet"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, wordless and very long texts, ties, copies and repeated rows."""
    near = " ".join(f"word{i} alpha beta" for i in range(60))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, "1234 5678 !!!", "en", "b", 13),
        (5, EN, "en", "a", len(EN)),
        (6, EN, "en", None, len(EN)),
        (7, EN.replace(" ", "  "), "en", "b", 90),
        (8, EN.upper(), "en", "b", 90),
        (9, DE, "de", "c", len(DE)),
        (10, near, "en", "c", len(near)),
        (11, near.replace("word7 ", "other "), "en", "c", len(near)),
        (12, " ".join(f"{EN} {i}" for i in range(2500)), "en", "a", 200_000),
        (13, "x" * 60_000, "en", "a", 60_000),
        (14, "one", None, "b", 3),
        (15, "one", "de", "b", 3),
        (16, "non breaking 　 wide\x1cspace", "fr", "é", 20),
        (17, "\U0001f600 emoji \U0001f600", "en", "b", 9),
        (18, "two  spaces\n\nand lines\n  end ", "en", "b", 30),
        (19, "a <|endoftext|> b", "en", "b", 17),
        (5, EN, "en", "a", len(EN)),
        (None, EN, "en", "a", len(EN)),
        (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique_rows(odd_rows):
    """One row per non-null id."""
    return {r[0]: r for r in odd_rows if r[0] is not None}
