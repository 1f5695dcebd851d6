import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, sources=None):
    return [(i, t, "en", sources[i] if sources else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a null id and a null source, and an odd further column."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    texts = [None, "", "  \t ", "one", "one two three four five six", long, "The token = abcdef12", "naïve café — ☃ 𝄞 text", "x" * 5000]
    data = rows(texts) + [(3, "one", "en", "src0", 3), (4, "other text here", "en", None, 1), (None, "one", None, None, None), (None, None, None, None, None)]
    data += [(100 + i, "same line\nagain and again and more words", "en", "src1", 1) for i in range(40)]
    return spark.createDataFrame([(*r, "clash") for r in data], COLUMNS + ", size string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
