"""The 17 metrics on a small fact."""

import pytest
from pyspark.sql import functions as F

from conftest import d, m
from shopledger.metrics import METRICS, metric


@pytest.fixture(scope="module")
def marts(spark):
    orders = spark.createDataFrame(
        [
            ("1", "A", d("2024-01-01"), "delivered", "web", m("100.00"), m("90.00"), m("10.00"), True, False, True, 2),
            ("2", "A", d("2024-01-08"), "cancelled", "web", m("50.00"), m("50.00"), m("0.00"), False, True, False, 0),
            ("3", "B", d("2024-02-03"), "delivered", "app", m("10.00"), m("10.00"), m("0.00"), True, False, False, 5),
            ("4", "X", d("2024-02-04"), "delivered", "app", None, None, None, True, False, None, None),
        ],
        "order_id string, customer_id string, order_date date, order_status string, channel string, gross_revenue_eur decimal(18,2), "
        "net_revenue_eur decimal(18,2), discount_amount_eur decimal(18,2), is_first_order boolean, has_returned boolean, "
        "is_late_delivery boolean, days_to_ship int",
    )
    customers = spark.createDataFrame(
        [("A", d("2023-01-01"), "FR", m("140.00")), ("B", d("2023-01-02"), "DE", m("10.00"))],
        "customer_id string, signup_date date, country string, lifetime_value_eur decimal(18,2)",
    )
    products = spark.createDataFrame([("P", d("2022-01-01"), m("40.0000")), ("Q", d("2022-05-01"), m("50.0000"))], "product_id string, launched_at date, margin_pct decimal(10,4)")
    return {"fct_orders": orders, "dim_customers": customers, "dim_products": products}


def test_there_are_seventeen():
    assert len(METRICS) == 17


@pytest.mark.parametrize(
    "name, value",
    [
        ("total_customers", 2), ("avg_ltv", 75.0), ("total_products", 2), ("avg_product_margin", 45.0), ("total_revenue", 150),
        ("total_gross_revenue", 160), ("total_orders", 4), ("average_order_value", 50.0), ("total_discount_amount", 10),
        ("new_customer_orders", 3), ("returned_order_count", 1), ("late_delivery_orders", 1), ("avg_days_to_ship", 7 / 3),
        ("discount_rate", 0.0625), ("late_delivery_rate", 0.25),
    ],
)
def test_overall(marts, name, value):
    assert float(metric(name, marts).first()[name]) == pytest.approx(value)


def test_no_value_gives_zero(marts):
    got = {r.channel: r for r in metric("total_revenue", marts, ["channel"], where="order_id = '4'").collect()}
    assert float(got["app"].total_revenue) == 0.0
    assert metric("average_order_value", marts, where="order_id = '4'").first()[0] == 0.0
    assert metric("discount_rate", marts, where="order_id = '4'").first()[0] is None  # nothing to divide by


def test_grain_and_filter(marts):
    got = {r.period: float(r.total_revenue) for r in metric("total_revenue", marts, grain="month", where=F.col("channel") == "web").collect()}
    assert got == {d("2024-01-01"): 140.0}
    weeks = {r.period: r.total_orders for r in metric("total_orders", marts, grain="week").collect()}
    assert weeks == {d("2024-01-01"): 1, d("2024-01-08"): 1, d("2024-01-29"): 2}


def test_dimension_of_the_customer(marts):
    got = {r.customer__country: float(r.total_revenue) for r in metric("total_revenue", marts, ["customer__country"]).collect()}
    assert got == {"FR": 140.0, "DE": 10.0, None: 0.0}
    aov = {r.customer__country: r.average_order_value for r in metric("average_order_value", marts, ["customer__country"], grain="year").collect()}
    assert aov["FR"] == 70.0


def test_trailing_days(marts):
    got = {r.period: float(r.revenue_last_7_days) for r in metric("revenue_last_7_days", marts).collect()}
    assert len(got) == 35  # every day from the first to the last order
    assert got[d("2024-01-07")] == 90.0 and got[d("2024-01-08")] == 50.0 and got[d("2024-01-15")] == 0.0


def test_trailing_at_a_coarser_grain_takes_the_first_day(marts):
    got = {r.period: float(r.revenue_last_30_days) for r in metric("revenue_last_30_days", marts, grain="month").collect()}
    assert got == {d("2024-01-01"): 90.0, d("2024-02-01"): 50.0}


def test_only_keys_can_be_counted(marts):
    from shopledger import metrics

    metrics.METRICS["bad"] = metrics.Simple("fct_orders", "count_distinct", "channel")
    try:
        with pytest.raises(ValueError):
            metric("bad", marts)
    finally:
        del metrics.METRICS["bad"]
