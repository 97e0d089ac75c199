import pytest

from labelmill.llm.ship import ship
from tests.conftest import spark  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row_id string"


@pytest.fixture
def docs(spark):  # noqa: F811
    """Documents from texts; ids count from 0 unless given; two columns have names the operators use."""

    def build(texts, ids=None, langs=None):
        rows = [
            (i, t, l, "s", len(t or ""), None, "x")
            for i, t, l in zip(ids or range(len(texts)), texts, langs or [None] * len(texts))
        ]
        return ship(spark).createDataFrame(rows, SCHEMA)

    return build
