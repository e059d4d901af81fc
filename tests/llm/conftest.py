import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """The same with a row that repeats, rows without an id, and columns whose names operators like to use."""
    more = [*rows, rows[0], rows[3], (None, "a text without an id", None, None, None), (None, None, None, None, None)]
    names = ("key", "h", "n", "gone", "block", "node", "dc", "sd", "ld_n_lines", "q_kept", "mix_copies", "main_text", "bucket", "unit")
    df = spark.createDataFrame(more, SCHEMA)
    return df.selectExpr("*", *(f"'{i}' as {x}" for i, x in enumerate(names)))
