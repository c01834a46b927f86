import pytest

ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog " * 30),
    (2, "the quick brown fox jumps over the lazy dog " * 30),
    (3, None),
    (4, ""),
    (5, "  two  spaces\n\n and\ttabs \n"),
    (6, "é è 🎉 ünïcode\x1c text Ⅷ ½ 中文 don't I'LL"),
    (7, "x" * 3000),
    (8, "the quick brown fox jumps over the lazy cat " * 30 + "and then some more words follow here"),
    (None, "a text without an id"),
    (9, "word " * 5000),
    (9, "word " * 5000),
    (10, "\\### Assistant: </turn> ok"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty and very long texts, ties, repeated rows, and columns whose names clash with outputs."""
    rows = [(i, t, "en", f"src{n % 2}", None, 7, 8) for n, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids bigint, key bigint").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """Rows of the smallest test tables, for comparisons with brute force."""
    return "/root/testdata/sf0.001"
