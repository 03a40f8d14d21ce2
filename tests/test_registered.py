"""Every registered query against its SQL statement, and the shape of the plans."""

import re
import sys

import pytest

from conftest import ROOT, SMALL

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402
from shopledger.catalogue import registered_queries, registered_statements  # noqa: E402

QUERIES, STATEMENTS = registered_queries(), registered_statements()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert sum(k.startswith("m") for k in QUERIES) == 38 and sum(k.startswith("j") for k in QUERIES) == 17


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert compare(df, con, STATEMENTS[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|MapInPandas|MapInArrow|CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_the_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scans_are_pruned_and_filtered(spark):
    from shopledger.catalogue import models

    m = models(spark, SMALL)
    plan = m.daily_flash_report._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_tax" not in s and "l_shipdate" not in s and "o_totalprice" not in s for s in schemas)
    country = m.country_revenue_breakdown._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" in country and "CartesianProduct" not in country
