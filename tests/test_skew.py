"""All models on skewed data, with every splitting path switched on.

A third of the order lines sits in one order, a third has one product, and a third of the orders belongs to
one customer. Limits are set so low that heavy keys, slices, shuffled lookups and wide baskets occur.
"""

import shutil
import sys

import duckdb
import pytest

from conftest import ROOT, SMALL

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import TABLES, compare, connect  # noqa: E402

LOW = {"heavyRows": "20", "localRows": "0", "wideGroup": "6"}
AFFECTED = [
    "m11_int_orders_enriched", "m12_int_customer_order_summary", "m15_int_shipment_summary",
    "m16_int_product_performance", "m18_dim_products", "m19_fct_orders", "m20_fct_order_items", "m21_fct_payments",
    "m23_fct_refunds", "m24_monthly_revenue_summary", "m25_product_margin_analysis", "m29_customer_ltv",
    "m30_cohort_analysis", "m31_channel_attribution", "m33_customer_features", "m34_order_sequence_features",
    "m35_product_affinity_features", "m37_customer_lifetime_value_features", "m38_recommendation_input",
    "a13_next_keys", "j15_late_delivery_rate", "j17_revenue_last_30_days",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for t in TABLES:
        if t not in ("orders", "lineitem"):
            shutil.copyfile(f"{SMALL}/{t}.parquet", folder / f"{t}.parquet")
    con.execute(
        f"""copy (select * replace (if(o_orderkey % 3 = 0, 7, o_custkey) as o_custkey)
                  from read_parquet('{SMALL}/orders.parquet')) to '{folder}/orders.parquet' (format parquet)"""
    )
    con.execute(
        f"""copy (
          with l as (select *, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate))::int n from read_parquet('{SMALL}/lineitem.parquet'))
          select * exclude (n) replace (if(n % 3 = 0, 1, l_orderkey) as l_orderkey, if(n % 3 = 1, 3, l_partkey) as l_partkey,
                                        if(n % 2 = 0, l_linenumber, n + 10) as l_linenumber)
          from l) to '{folder}/lineitem.parquet' (format parquet)"""
    )
    return str(folder)


@pytest.fixture(scope="module")
def low_limits(spark):
    for name, value in LOW.items():
        spark.conf.set(f"spark.shopledger.{name}", value)
    yield
    for name in LOW:
        spark.conf.unset(f"spark.shopledger.{name}")


@pytest.mark.parametrize("name", AFFECTED)
def test_model_on_skewed_data(spark, skewed, low_limits, name):
    df = entry.queries()[name](spark, skewed)
    assert compare(df, connect(skewed), entry.oracle_sql()[name]) is None


def test_the_splitting_paths_are_on(spark, skewed, low_limits):
    from shopledger.catalogue import models
    from shopledger.operators.skew import heavy_keys

    m = models(spark, skewed)
    assert "1" in dict(heavy_keys(m.stg_order_items, "order_id").parts)
    assert "3" in dict(heavy_keys(m.stg_order_items, "product_id").parts)
    assert "7" in dict(heavy_keys(m.stg_orders, "customer_id").parts)
    sequence = m.order_sequence_features._jdf.queryExecution().optimizedPlan().toString()
    assert "_cut" in sequence
