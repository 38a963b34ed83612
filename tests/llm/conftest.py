import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) rows, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            for name in ("tokens", "n", "score", "pos", "rank", "length", "part", "kept", "c", "label"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
