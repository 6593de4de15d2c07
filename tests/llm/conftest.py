import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Small documents with all the odd cases, and columns whose names clash with those of results."""

    def make(texts, **columns):
        rows = [
            (i, text, None if i % 5 == 4 else f"s{i % 3}", len(text or ""), 0.5, -1, "x") for i, text in enumerate(texts)
        ]
        frame = spark.createDataFrame(
            rows, "doc_id long, text string, source string, n_chars long, score double, n_lines int, row string"
        )
        return frame.repartition(3)

    return make
