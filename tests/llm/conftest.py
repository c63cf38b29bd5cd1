import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def build(rows):
        full = [(d, t, "en", None if d is None else f"src{d % 2}", None if t is None else len(t), 7, "x") for d, t in rows]
        return spark.createDataFrame(full, SCHEMA + ", k int, th string").coalesce(2)

    return build

