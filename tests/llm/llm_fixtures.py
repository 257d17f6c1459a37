import pytest

TEXT = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), over several partitions."""

    def make(rows, parts=3):
        rows = [(*r, "s")[:3] for r in rows]
        return spark.createDataFrame(rows, TEXT).repartition(parts)

    return make
