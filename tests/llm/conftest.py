import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_corpus import corpus  # noqa: E402

from changeloom.llm.shared import Scratch  # noqa: E402

@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def docs(spark):
    """The corpus with further columns, some with the operators' own names."""
    rows = [(i, t, "x", -1, b"y") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, batch int, h binary").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
