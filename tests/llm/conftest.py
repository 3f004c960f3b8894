import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = "\n".join(f"line {i} of a long text with words {i * 7 % 101}" for i in range(6000))
    rows = [
        (1, "a b c d e f g\nsecond line here\nthird line here\nfourth", "en", "s1", 10),
        (1, "a b c d e f g\nsecond line here\nthird line here\nfourth", "en", "s1", 10),
        (2, "A B c d e f g\nsecond line here\nthird line here\nfourth", "en", "s2", 10),
        (3, None, None, None, None), (4, "", "en", "s1", 0), (None, "some words without id", "en", "s1", 3), (None, None, None, None, None),
        (5, "   \n\t ", "en", "s3", 6), (6, long_text, "en", "s1", len(long_text)), (7, "stupid idiot <|endoftext|> naïve 日本語   x", "de", "s2", 9), (8, "one", "en", None, 3),
    ]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
