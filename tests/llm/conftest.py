import pytest


@pytest.fixture(scope="session")
def tiny(spark):
    """Documents with NULLs, empty and repeated texts, ties, and a column that clashes with internal names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en", "a"),
        (2, "", "en", "b"),
        (3, None, None, "c"),
        (4, "The quick brown fox jumps over the lazy dog and runs far away from here.", None, "d"),
        (5, "12345 !!! ???", "de", "e"),
        (6, "x" * 5000 + " Ünïcödé 😀 日本語 " + "y" * 3000, "de", "f"),
        (None, "a text without a key is a text all the same", "en", "g"),
        (7, "one", "en", "h"),
        (7, "one", "en", "h"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")


@pytest.fixture(scope="session")
def nothing(tiny):
    return tiny.where("false")
