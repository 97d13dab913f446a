"""The queries that SQL can express give what DuckDB gives, over whole tables."""

import os

import pytest

from symreach.llm.queries import QUERIES
from symreach.llm.sql import ORACLES
from tests.test_oracle import SF, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    assert compare(QUERIES[name](spark, os.environ.get("TEST_SF_DIR", SF)), ORACLES[name], SF) > 0
