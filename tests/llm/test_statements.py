"""Queries that SQL can express, against their statements."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, connect  # noqa: E402

from shopledger.llm.queries import QUERIES, STATEMENTS  # noqa: E402


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), STATEMENTS[name]) is None
