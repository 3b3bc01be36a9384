import pytest

LONG = "word " * 40_000 + "end"

# Columns with names that operators use inside; none of them may be touched or clash.
EXTRA = ", ".join(f"{c} string" for c in ("id", "cls", "rows", "block", "owner", "runs", "ids", "score", "size", "target", "text_hash", "key"))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "nobody knows my number here", "en", "b"),
    (4, LONG, "en", "b"),
    (5, " \t\n ", "de", "b"),
    (6, "The quick brown fox jumps over the lazy dog today.", "en", "a"),
    (6, "The quick brown fox jumps over the lazy dog today.", "en", "a"),
    (7, "Straße 12 ٣٤ 日本語 \U0001f600 it's we'll don't", None, None),
    (8, "kurz", "de", "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    n = len(EXTRA.split(","))
    return spark.createDataFrame([r + ("x",) * n for r in ROWS], f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
