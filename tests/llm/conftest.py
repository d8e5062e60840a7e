import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import DOCS, prose, row  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        row(1, prose(1, 300)), row(2, None), row(3, ""), row(4, "   \n\t "), row(5, "word"), row(None, prose(2, 80)),
        row(6, prose(3, 60)), row(6, prose(3, 60)), row(7, "!!! ... ??"), row(8, "x" * 300_000), row(9, prose(4, 40_000)),
        row(10, prose(1, 300)), (11, prose(5, 90), None, None, None), row(12, "日本語 한국어 été ÀÉ"),
    ]
    made = spark.createDataFrame(rows, DOCS)
    extra = {"k": "k", "t": "t", "id": "i", "key": "y", "words": "w", "score": "s", "rate": "r", "keys": "q", "v": "v"}
    return made.selectExpr("*", *[f"'{v}' as `{c}`" for c, v in extra.items()])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (9, 1, 1), (5, None, None), (None, 1, 0), (11, 0, None)], "doc_id bigint, quality int, toxic int")
