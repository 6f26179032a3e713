import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns from (id, text) pairs."""
    def make(rows, **names):
        ids, texts = names.get("id", "doc_id"), names.get("text", "text")
        return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], f"{ids} long, {texts} string, start string, length string, score long").repartition(3)

    return make
