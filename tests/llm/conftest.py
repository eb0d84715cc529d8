import pytest
from llm_samples import EXTRA, SCHEMA, texts


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those inside the operators."""
    frame = spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA)
    return frame.repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
