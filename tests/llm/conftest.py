import pytest

from tablewright.llm.common import importable

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox 12.5 jumps over " * 9000


@pytest.fixture(autouse=True)
def _importable(spark):
    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "s", 35),
        (2, "alpha BETA gamma delta epsilon zeta", "en", None, None),
        (3, None, "en", "s", None),
        (4, "", None, "s", 0),
        (5, LONG, "en", "s", len(LONG)),
        (5, LONG, "en", "s", len(LONG)),
        (6, LONG + "end", "en", None, None),
        (None, "no id at all here now", "en", "s", 21),
        (None, None, None, None, None),
        (7, "  \t\n ", "en", "s", 5),
        (8, "12 34 !!", "en", "s", 8),
        (9, "Ünïcode ß 中文 \U0001f600 text", "de", "s", 20),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("kept", "keep_id", "score", "lang_pred", "id", "n", "count", "key", "set", "part", "block", "n_tokens", "rank"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df
