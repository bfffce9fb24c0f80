import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank TODAY.", None, "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "b"),
    (None, "Où est la bibliothèque? Je ne sais pas, mais le château est là.", "fr", "b"),
    (7, "1234 !!! ###", "de", "c"),
    (8, "word " * 30_000, "en", "c"),
    (9, "日本語のテキスト", "ja", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeats, a long text, and columns whose names clash with those of operators."""
    rows = [(*r, len(r[1] or ""), "x", 1, 2.0) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, component_id double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
