import pytest

LONG = "ab" * 150_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and extra columns with names that operators use."""
    said = "Send the signed copy to anna.lee@mail.example.com or call +1 (415) 555-2671 today.\n" * 3
    rows = [
        (1, None, "en", "s1", 0),
        (2, "", None, "s1", 0),
        (3, " \t\n \r ", "en", None, 6),
        (4, LONG, "en", "s2", len(LONG)),
        (5, said, "en", "s2", len(said)),
        (5, said, "en", "s2", len(said)),
        (6, said, None, None, None),
        (None, "a b c d e f g h", "en", "s1", 15),
        (7, "A b c d E f g h", "en", "s1", 15),
        (8, "one two three", "en", "s1", 13),
        (9, "ONE two\tthree", "en", "s3", 13),
        (10, "ünïcode \U0001f600 tökens… \x1c \x85 <|endoftext|> x", "de", "s4", 30),
    ]
    clash = "words array<string>, row string, spans string, start int, length int, element long, low int, end int, a long, b long, anchor long, x int, r double, score double, block long, live string, owner string, `count` int"
    n = len(clash.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
