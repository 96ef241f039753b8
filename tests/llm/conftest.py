import pytest


@pytest.fixture()
def docs(spark):
    """A documents frame from (doc_id, text) or (doc_id, text, source) rows,
    with columns whose names the operators use themselves."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "mine", 0.5, "row") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, size int, spans string, "
                                           "score double, `__key` string")
    return make
