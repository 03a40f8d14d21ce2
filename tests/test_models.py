"""Intermediate models, marts and features on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import by, d, m, rows
from shopledger.plans import core, data_science, finance, intermediate, marketing
from shopledger.plans.models import RetailModels, StagedTables

AS_OF = dt.date(2024, 2, 29)


def order(i, customer, date, status="delivered", channel="website", country="FR", discount=None):
    return dict(order_id=i, customer_id=customer, order_date=d(date), order_status=status, channel=channel,
                shipping_country=country, discount_amount=None if discount is None else m(discount), discount_code="")


def item(i, order_id, product, price="100.00", qty="1", pct=None):
    return dict(order_item_id=i, order_id=order_id, product_id=product, quantity=m(qty), unit_price_at_order=m(price),
                discount_pct=None if pct is None else m(pct))


class Tables:
    pass


@pytest.fixture(scope="module")
def shop(spark, raw):
    t = Tables()
    t.spark = spark
    t.raw_customers = raw(
        "raw_customers",
        dict(customer_id="A", first_name="Ann", last_name="Ash", email=" ANN@X.FR ", birth_date=d("1990-12-31"), gender="F", country="FR",
             signup_date=d("2023-01-10"), loyalty_tier="Gold", acquisition_channel="referral"),
        dict(customer_id="B", first_name="Bob", last_name=None, email="b@x.fr", signup_date=d("2023-01-20"), country="FR",
             loyalty_tier="Bronze", acquisition_channel="website"),
        dict(customer_id="C", first_name="Cy", last_name="Coe", signup_date=d("2024-02-01"), loyalty_tier="None", acquisition_channel="in_store"),
        dict(customer_id="E", first_name="Eve", last_name="Elm", signup_date=d("2023-05-01"), loyalty_tier="Silver", acquisition_channel="website"),
    )
    t.raw_products = raw(
        "raw_products",
        dict(product_id="P1", product_name="Tote", category="Bags", unit_price=m("100.00"), cost_price=m("40.00")),
        dict(product_id="P2", product_name="Belt", category="Belts", unit_price=m("50.00"), cost_price=m("20.00")),
        dict(product_id="P3", product_name="Purse", category="Wallets", unit_price=m("30.00"), cost_price=m("12.00")),
        dict(product_id="P4", product_name="Clutch", category="Bags", unit_price=m("80.00"), cost_price=m("20.00")),
    )
    t.raw_orders = raw(
        "raw_orders",
        order("1", "A", "2023-01-15", "cancelled"),  # first order, cancelled
        order("2", "A", "2023-02-01", channel="mobile_app", discount="10.00"),
        order("3", "A", "2023-12-01"),  # 90 days before as_of
        order("4", "B", "2023-02-28", country="DE"),  # 366 days before as_of
        order("5", "B", "2023-02-28", country="DE"),  # same first day
        order("6", "A", "2024-02-28", "pending"),
        order("7", "E", "2023-03-01", "returned"),  # 365 days before as_of, no items
        order("8", None, "2024-02-10"),  # no customer
    )
    t.raw_order_items = raw(
        "raw_order_items",
        item("i1", "1", "P1"),
        item("i2", "2", "P1", pct="10.00"),
        item("i3", "2", "P2", "50.00", "2"),
        item("i4", "3", "P1"),
        item("i5", "3", "P2", "50.00"),
        item("i6", "4", "P2", "50.00"),
        item("i7", "5", "PX", "10.00"),  # unknown product
        item("i8", "6", "P3", "30.00"),
        item("i9", "2", "P1", "100.00"),  # the same product twice in one order
        item("i10", "99", "P1"),  # unknown order
        item("i11", "8", "P2", "50.00"),
    )
    t.raw_payments = raw(
        "raw_payments",
        dict(payment_id="p1", order_id="2", payment_date=d("2023-02-01"), payment_method="paypal", amount=m("100.00"), currency="EUR", payment_status="failed", gateway="paypal"),
        dict(payment_id="p2", order_id="2", payment_date=d("2023-02-03"), payment_method="card", amount=m("280.00"), currency="EUR", payment_status="completed", gateway="stripe"),
        dict(payment_id="p3", order_id="4", payment_date=d("2023-03-05"), payment_method="card", amount=m("50.00"), currency="usd", payment_status="refunded", gateway="stripe"),
        dict(payment_id="p4", order_id="77", payment_date=d("2023-03-06"), payment_method="card", amount=m("1.00"), currency="EUR", payment_status="refunded", gateway="stripe"),
    )
    t.raw_shipments = raw(
        "raw_shipments",
        dict(shipment_id="s1", order_id="2", carrier="DHL", shipped_at=None, shipment_status="in_transit"),
        dict(shipment_id="s2", order_id="2", carrier="UPS", shipped_at=d("2023-02-02"), delivered_at=d("2023-02-09"), shipment_status="delivered"),
        dict(shipment_id="s3", order_id="4", carrier="DPD", shipped_at=d("2023-03-01"), delivered_at=d("2023-03-09"), shipment_status="delivered"),
        dict(shipment_id="s4", order_id="5", carrier="DPD", shipped_at=None, shipment_status="in_transit"),
    )
    t.raw_returns = raw(
        "raw_returns",
        dict(return_id="r1", order_id="2", order_item_id="i2", return_requested_at=d("2023-02-11"), refund_status="completed"),
        dict(return_id="r2", order_id="3", order_item_id="i4", return_requested_at=d("2023-12-05"), refund_status="rejected"),
        dict(return_id="r3", order_id="1", order_item_id="", return_requested_at=d("2023-01-20"), refund_status="approved"),
        dict(return_id="r4", order_id="2", order_item_id="i2", return_requested_at=d("2023-02-21"), refund_status="pending"),
    )
    empty = ["raw_campaigns", "raw_campaign_attributions", "raw_web_events"]
    for name in empty:
        setattr(t, name, raw(name))
    return RetailModels(StagedTables(t), AS_OF)


def test_orders_enriched(shop):
    got = by(shop.int_orders_enriched, "order_id")
    assert len(got) == 8
    two = got["2"]
    assert (two.item_count, two.total_quantity, two.gross_revenue, two.net_revenue) == (3, 4, m("290.00"), m("280.00"))
    assert two.product_categories == "Bags, Belts" and two.has_returned
    assert got["7"].item_count == 0 and got["7"].gross_revenue == m("0.00") and got["7"].product_categories is None
    assert got["5"].product_categories == ""  # only an unknown product
    assert got["3"].has_returned  # a rejected return counts at order level
    assert [got[i].is_first_order for i in "12345678"] == [True, False, False, True, True, False, True, False]


def test_customer_summary(shop):
    got = by(shop.int_customer_order_summary, "customer_id")
    a, b = got["A"], got["B"]
    assert (a.total_orders, a.total_revenue, a.avg_order_value) == (2, m("430.00"), 215.0)
    assert (a.first_order_date, a.last_order_date) == (d("2023-02-01"), d("2023-12-01"))
    assert (a.days_since_last_order, a.customer_tenure_days) == (90, 393)
    assert a.favorite_category == "Bags" and a.total_items_returned == 4  # the cancelled order's return counts
    assert b.favorite_category == "Belts" and b.total_items_returned == 0
    assert got["E"].favorite_category is None and "C" not in got


def test_payment_summary(shop):
    got = by(shop.int_payment_summary, "order_id")
    two = got["2"]
    assert (two.total_paid_eur, two.payment_method, two.gateway, two.payment_status) == (m("280.00"), "card", "stripe", "failed")
    assert two.days_to_payment == 2 and not two.is_refunded
    assert (got["4"].refund_count, got["4"].total_refunded_eur, got["4"].is_refunded) == (1, m("46.00"), True)
    assert got["4"].total_paid_eur == m("0.00") and got["4"].payment_method is None
    assert got["77"].days_to_payment is None


def test_shipment_summary(shop):
    got = by(shop.int_shipment_summary, "order_id")
    assert (got["2"].shipment_id, got["2"].days_to_ship, got["2"].days_to_deliver, got["2"].is_late_delivery) == ("s2", 1, 7, False)
    assert (got["4"].days_to_deliver, got["4"].total_fulfillment_days, got["4"].is_late_delivery) == (8, 9, True)
    assert (got["5"].shipment_id, got["5"].days_to_ship, got["5"].is_late_delivery) == ("s4", None, False)


def test_product_performance(shop):
    got = by(shop.int_product_performance, "product_id")
    p1 = got["P1"]
    assert (p1.total_orders, p1.total_units_sold, p1.total_revenue) == (2, 3, m("290.00"))
    assert p1.return_count == 3 and p1.return_rate == 100.0
    assert p1.avg_days_to_return == pytest.approx((10 + 20 + 4) / 3)
    assert got["P2"].return_count == 0 and got["P2"].avg_days_to_return is None
    assert "P3" not in got and "PX" in got


def test_product_sales_shuffle_items_once(spark, shop):
    """Rows of a repeated order count each, as in a join with the orders."""
    kept = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in kept:
        spark.conf.set(name, "-1")
    try:
        orders = shop.stg_orders.unionByName(shop.stg_orders.where("order_id = '2'"))
        sales = intermediate.product_sales(shop.stg_order_items, orders)
        plan = sales._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(order_id") == 2 and plan.count("Exchange ") == 3
        twice, once = by(sales, "product_id"), by(intermediate.product_sales(shop.stg_order_items, shop.stg_orders), "product_id")
    finally:
        for name in kept:
            spark.conf.unset(name)
    items = shop.stg_order_items.where("order_id = '2'").groupBy("product_id").agg(F.sum("line_revenue").alias("r"), F.sum("quantity").alias("q"))
    more = {r.product_id: r for r in items.collect()}
    assert more and set(more) <= set(once)
    for p, r in once.items():
        extra = more.get(p)
        assert twice[p].total_orders == r.total_orders + (extra is not None)
        assert twice[p].total_revenue == r.total_revenue + (extra.r if extra else 0)
        assert twice[p].total_units_sold == r.total_units_sold + (extra.q if extra else 0)


def test_tiers_need_no_returns(shop):
    columns = ["product_id", "product_name", "category", "current_price", "performance_tier"]
    assert rows(shop.tiered_products, *columns) == rows(shop.dim_products, *columns)
    assert "return_rate" not in shop.tiered_products.columns


def test_dim_customers(shop):
    got = by(shop.dim_customers, "customer_id")
    assert [got[c].customer_status for c in "ABCE"] == ["active", "churned", "prospect", "at_risk"]
    assert got["A"].age == 34 and got["A"].full_name == "Ann Ash" and got["B"].full_name is None
    assert (got["C"].total_orders, got["C"].lifetime_value_eur, got["C"].avg_order_value_eur) == (0, m("0.00"), 0.0)
    assert got["C"].days_since_last_order is None


def test_dim_products(shop):
    got = by(shop.dim_products, "product_id")
    assert [got[p].performance_tier for p in ("P1", "P2", "P3", "P4")] == ["hero", "core", "niche", "long_tail"]
    assert got["P3"].total_revenue == m("0.00") and got["P3"].return_rate == m("0.0000")
    assert got["P1"].avg_days_to_return == m("11.33")


def test_dim_date(spark):
    got = core.dim_date(spark)
    assert got.count() == 1826
    days = by(got.where("date_day in (date '2022-01-01', date '2024-02-29', date '2026-12-31')"), "date_day")
    first = days[d("2022-01-01")]
    assert (first.date_key, first.day_of_week, first.day_name, first.month_name, first.week_of_year) == (20220101, 6, "Sat", "Jan", 52)
    assert first.is_weekend and not first.is_weekday and first.is_first_day_of_month and not first.is_last_day_of_month
    assert (first.fiscal_quarter, first.fiscal_year, first.season, first.year_month, first.year_str) == ("FQ4", 2021, "Winter", "2022-01", "2022")
    assert days[d("2024-02-29")].is_last_day_of_month and d("2026-12-31") in days


def test_fct_orders(shop):
    got = by(shop.fct_orders, "order_id")
    assert got["3"].payment_method == "unknown" and got["3"].payment_status == "unknown"
    assert got["3"].is_refunded is None and got["3"].total_paid_eur is None
    assert (got["3"].days_to_ship, got["3"].is_late_delivery, got["3"].carrier) == (0, False, None)
    assert (got["2"].order_date_key, got["2"].carrier, got["4"].is_late_delivery) == (20230201, "UPS", True)


def test_fct_order_items(shop):
    got = by(shop.fct_order_items, "order_item_id")
    assert "i10" not in got and len(got) == 10
    assert got["i2"].has_been_returned and not got["i4"].has_been_returned  # rejected returns do not count here


def test_fct_payments_and_refunds(shop):
    payments = by(shop.fct_payments, "payment_id")
    assert payments["p4"].customer_id is None and payments["p4"].days_to_payment is None
    got = by(shop.fct_refunds, "payment_id")
    assert set(got) == {"p3", "p4"}
    assert (got["p3"].monthly_refund_count, got["p3"].monthly_total_refunds_eur) == (2, m("47.00"))
    # revenue of the order's month (February 2023: 280 + 50 + 10), refunds of the payment month (March)
    assert got["p3"].monthly_refund_rate_pct == 13.82 and got["p3"].days_to_refund == 5
    assert got["p4"].monthly_refund_rate_pct is None and got["p4"].channel is None


def test_fct_revenue(shop):
    got = {(r.date_day, r.channel): r for r in shop.fct_revenue.collect()}
    de = got[d("2023-02-28"), "website"]
    assert (de.order_count, de.net_revenue_eur, de.avg_order_value_eur) == (2, m("60.00"), 30.0)
    assert got[d("2023-12-01"), "website"].cumulative_ytd_revenue == m("150.00") + m("0.00")  # FR only
    assert d("2023-01-15") not in {k[0] for k in got}


def test_running_sums_restart(shop, spark):
    days = [("2023-01-30", 1), ("2023-01-31", 2), ("2023-02-01", 4), ("2024-02-01", 8)]
    frame = spark.createDataFrame([(str(i), d(t), "c", "X", "delivered", m(f"{v}.00"), m("0.00"), m(f"{v}.00")) for i, (t, v) in enumerate(days)],
        "order_id string, order_date date, channel string, shipping_country string, order_status string, gross_revenue_eur decimal(18,2), discount_amount_eur decimal(18,2), net_revenue_eur decimal(18,2)")
    got = finance.fct_revenue(frame).orderBy("date_day").collect()
    assert [(float(r.cumulative_mtd_revenue), float(r.cumulative_ytd_revenue)) for r in got] == [(1, 1), (3, 3), (4, 7), (8, 8)]


def facts(spark, *lines):
    """(order_id, customer_id, date, status, net, first?, channel, country)"""
    schema = "order_id string, customer_id string, order_date date, order_status string, net_revenue_eur decimal(18,2), is_first_order boolean, channel string, shipping_country string"
    return spark.createDataFrame([(a, b, d(c), s, m(n), f, ch, co) for a, b, c, s, n, f, ch, co in lines], schema)


def test_monthly_summary_counts_back_rows_not_months(spark):
    months = [f"{2022 + i // 12}-{i % 12 + 1:02d}-10" for i in range(14) if i != 5]  # June 2022 is missing
    frame = facts(spark, *[(str(i), "A", t, "delivered", f"{100 + i}.00", i == 0, "w", "FR") for i, t in enumerate(months)])
    got = by(finance.monthly_revenue_summary(frame), "year_month")
    assert len(got) == 13 and got["2022-02"].mom_revenue_growth_pct == 1.0
    assert got["2023-02"].yoy_revenue_growth_pct == 12.0  # against January 2022, 12 rows back
    assert got["2022-01"].new_customers == 1 and got["2022-01"].returning_customers == 0
    assert got["2022-01"].mom_orders_growth_pct is None


def test_growth_after_a_month_of_zero_revenue(spark):
    frame = facts(spark, ("1", "A", "2024-01-01", "delivered", "0.00", True, "w", "FR"), ("2", "A", "2024-02-01", "delivered", "5.00", False, "w", "FR"))
    assert by(finance.monthly_revenue_summary(frame), "year_month")["2024-02"].mom_revenue_growth_pct is None


def test_margin_analysis(shop):
    got = shop.product_margin_analysis.collect()
    product = {r.product_id: r for r in got if r.aggregation_level == "product"}
    category = {r.category: r for r in got if r.aggregation_level == "category"}
    assert (product["P1"].units_sold, product["P1"].total_cost_eur, product["P1"].gross_margin_eur) == (3, m("120.00"), m("170.00"))
    assert product["P1"].realized_margin_pct == 58.62
    assert product["P4"].realized_margin_pct == 75.0 and product["P4"].avg_selling_price_eur == 80.0  # never sold
    assert category["Bags"].current_price == 90.0 and category["Bags"].avg_selling_price_eur == 90.0
    assert category["Wallets"].realized_margin_pct is None  # no revenue
    assert category["Bags"].product_id is None


def test_daily_flash_report_on_a_leap_day(spark):
    as_of = dt.date(2024, 2, 29)
    frame = facts(
        spark,
        ("1", "A", "2024-02-29", "delivered", "30.00", False, "w", "FR"),
        ("2", "A", "2023-02-28", "delivered", "20.00", False, "w", "FR"),
        ("3", "A", "2024-01-30", "delivered", "5.00", False, "w", "FR"),  # exactly 30 days back
        ("4", "A", "2024-01-29", "delivered", "5.00", False, "w", "FR"),  # too old
        ("5", "A", "2024-02-10", "pending", "5.00", False, "w", "FR"),
    )
    got = by(finance.daily_flash_report(frame, as_of), "date_day")
    assert set(got) == {d("2024-02-29"), d("2024-01-30")}
    leap = got[d("2024-02-29")]
    assert (leap.py_orders, leap.py_revenue_eur, leap.revenue_vs_py_pct, leap.orders_vs_py_pct) == (1, m("20.00"), 50.0, 0.0)
    assert got[d("2024-01-30")].revenue_vs_py_pct is None


def test_country_breakdown_drops_last_year_only(spark):
    frame = facts(
        spark,
        ("1", "A", "2024-01-05", "delivered", "75.00", False, "w", "FR"),
        ("2", "A", "2024-12-31", "delivered", "25.00", False, "w", "DE"),
        ("3", "A", "2023-12-31", "delivered", "50.00", False, "w", "FR"),
        ("4", "A", "2023-06-01", "delivered", "9.00", False, "w", "IT"),
        ("5", "A", "2022-06-01", "delivered", "9.00", False, "w", "FR"),
    )
    got = by(finance.country_revenue_breakdown(frame, AS_OF), "country")
    assert set(got) == {"FR", "DE"}
    assert (got["FR"].pct_of_total_revenue, got["FR"].py_revenue_eur, got["FR"].yoy_growth_pct) == (75.0, m("50.00"), 50.0)
    assert got["DE"].yoy_growth_pct is None


def customer_row(spark, *lines):
    """(customer_id, total_orders, lifetime value, days since last order)"""
    schema = "customer_id string, total_orders bigint, lifetime_value_eur decimal(18,2), days_since_last_order int"
    frame = spark.createDataFrame([(a, b, m(c), e) for a, b, c, e in lines], schema)
    for name in ("full_name", "email", "country", "loyalty_tier", "acquisition_channel", "customer_status", "favorite_category"):
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    return frame.withColumn("last_order_date", F.lit(None).cast("date")).withColumn("first_order_date", F.lit(None).cast("date"))


def test_segments_at_the_band_limits(spark):
    cases = [
        ("champion", 4, "1500.00", 30, (5, 4, 5), "Champions"),
        ("loyal", 2, "199.99", 90, (3, 3, 2), "Loyal"),
        ("new", 1, "200.00", 60, (4, 2, 3), "New"),
        ("potential", 1, "600.00", 61, (3, 2, 4), "Potential Loyalist"),
        ("risk", 3, "599.99", 91, (2, 3, 3), "At Risk"),
        ("lose", 7, "10.00", 180, (2, 5, 2), "Cant Lose Them"),
        ("hibernating", 1, "300.00", 181, (1, 2, 3), "Hibernating"),
        ("lost", 0, "0.00", None, (1, 1, 1), "Lost"),
        ("promising", 1, "10.00", 100, (2, 2, 2), "Promising"),
    ]
    got = by(marketing.customer_segments(customer_row(spark, *[c[:4] for c in cases]), AS_OF), "customer_id")
    for name, _, _, _, scores, segment in cases:
        r = got[name]
        assert (r.recency_score, r.frequency_score, r.monetary_score, r.rfm_segment) == (*scores, segment), name
        assert r.rfm_total_score == sum(scores) and r.segmented_at == AS_OF


def test_customer_ltv(shop):
    got = by(shop.customer_ltv, "customer_id")
    assert set(got) == {"A", "B", "E"}
    assert got["A"].estimated_annual_frequency == 1.2  # 365 / 303 days
    assert got["A"].predicted_12m_ltv_eur == 258.0
    # gap of 0 days: the order count is shown, the value is taken once
    assert (got["B"].estimated_annual_frequency, got["B"].predicted_12m_ltv_eur) == (2.0, 30.0)
    assert got["E"].estimated_annual_frequency == 1.0 and got["A"].ltv_segment == "Low LTV"


def test_cohorts(shop):
    got = {(r.signup_cohort_month, r.order_cohort_month): r for r in shop.cohort_analysis.collect()}
    feb = got["2023-01", "2023-02"]
    assert (feb.cohort_base_size, feb.active_customers, feb.cohort_order_count, feb.cohort_revenue) == (2, 2, 3, m("340.00"))
    assert (feb.retention_rate_pct, feb.period_number) == (100.0, 1)
    assert got["2023-01", "2023-12"].retention_rate_pct == 50.0
    assert ("2023-05", "2023-03") not in got  # returned orders do not count


def test_channel_attribution(shop):
    got = by(shop.channel_attribution, "channel")
    assert set(got) == {"website", "mobile_app"}  # referral only acquires
    web = got["website"]
    assert (web.last_touch_revenue_eur, web.last_touch_orders) == (m("260.00"), 4)
    assert (web.first_touch_revenue_eur, web.first_touch_orders) == (m("60.00"), 2)
    assert float(web.linear_revenue_eur) == 130.0 + 30.0
    assert web.last_touch_pct_of_total == 48.15
    assert float(got["mobile_app"].linear_revenue_eur) == 140.0


def test_campaign_performance(shop):
    got = {(r.campaign_id, r.week_start): r for r in shop.fct_campaign_performance.collect()}
    week = got["website", d("2023-02-27")]
    assert (week.conversions, week.attributed_revenue_eur, week.roas, week.cpa_eur) == (2, m("60.00"), 10.0, 3.0)


def test_customer_features(shop):
    got = by(shop.customer_features, "customer_id")
    a = got["A"]
    assert a.preferred_channel == "mobile_app" and a.distinct_channels_used == 2  # tie goes to the smaller name
    assert a.std_order_value == pytest.approx(91.9239, abs=1e-4) and a.return_rate == 2.0
    assert (a.loyalty_tier_encoded, got["C"].loyalty_tier_encoded) == (3, 0)
    assert got["E"].std_order_value == 0.0 and got["C"].preferred_channel is None and got["C"].distinct_channels_used == 0
    assert got["C"].has_returned_items is False and got["C"].return_rate == 0.0 and a.active_flag


def test_order_sequence(shop):
    got = by(shop.order_sequence_features, "order_id")
    assert (got["2"].order_number, got["2"].days_between_orders, got["2"].aov_trend) == (1, None, "first_order")
    assert (got["3"].order_number, got["3"].days_between_orders, got["3"].aov_trend) == (2, 303, "declining")
    assert (got["4"].order_number, got["5"].order_number, got["5"].days_between_orders) == (1, 2, 0)
    assert (got["3"].channel_consistency, got["4"].channel_consistency) == ("mixed", "consistent")
    assert got["8"].channel_consistency == "omnichannel" and got["8"].total_distinct_channels is None


def test_value_trend_limits(spark):
    frame = facts(spark, *[(str(i), "A", f"2024-01-{i + 1:02d}", "delivered", n, False, "w", "FR") for i, n in enumerate(["100.00", "110.00", "99.00", "108.91", "98.00"])])
    got = data_science.order_sequence_features(frame).orderBy("order_number").collect()
    assert [r.aov_trend for r in got] == ["first_order", "stable", "stable", "growing", "declining"]


def test_product_affinity(shop):
    got = by(shop.product_affinity_features, "product_id")
    p1, p2 = got["P1"], got["P2"]
    assert (p1.cross_sell_product_id, p1.cross_sell_product_name, p1.affinity_score) == ("P2", "Belt", 2)
    assert p1.avg_basket_size_with_product == 2.0
    assert p2.avg_basket_size_with_product == 1.5  # orders 2, 3 with two products, 4 and 8 with one
    assert (got["P3"].cross_sell_product_id, got["P3"].affinity_score, got["P3"].avg_basket_size_with_product) == (None, 0, 1.0)


def test_churn_input(shop):
    got = by(shop.churn_prediction_input, "customer_id")
    assert [got[c].is_churned for c in "ABCE"] == [False, True, True, True]
    assert got["A"].predicted_churn_probability_placeholder is None


def test_churn_limit(spark, shop):
    frame = shop.customer_features.where("customer_id = 'A'")
    for days, churned in ((180, False), (181, True)):
        assert data_science.churn_prediction_input(frame.withColumn("recency_days", F.lit(days))).first().is_churned is churned


def test_lifetime_value_features(shop):
    got = by(shop.customer_lifetime_value_features, "customer_id")
    a = got["A"]
    assert (a.months_since_signup, a.avg_inter_order_days, a.pct_of_avg_cycle_elapsed) == (13, 303.0, 29.7)
    assert (a.active_purchase_months, a.orders_per_active_month) == (2, 1.0)
    assert (got["B"].avg_inter_order_days, got["B"].pct_of_avg_cycle_elapsed, got["B"].orders_per_active_month) == (0.0, None, 2.0)
    assert (got["C"].active_purchase_months, got["C"].ltv_tier_label, a.ltv_tier_label) == (0, "very_low", "low")


def test_recommendation_input(shop):
    got = {(r.customer_id, r.product_id): r for r in shop.recommendation_input.collect()}
    a = got["A", "P1"]
    assert (a.purchase_count, a.total_units, a.revenue) == (3, 3, m("290.00"))
    assert (a.first_purchased_date, a.last_purchased_date, a.days_since_purchase) == (d("2023-02-01"), d("2023-12-01"), 90)
    assert a.implicit_rating == 5.6733 and ("B", "PX") not in got


def test_ties_in_customer_months(spark):
    """Equal dates leave a mean gap of zero; a single order leaves none."""
    frame = facts(spark, ("1", "A", "2024-01-01", "delivered", "1.00", True, "w", "FR"), ("2", "A", "2024-01-01", "delivered", "1.00", True, "w", "FR"))
    gaps = frame.groupBy("customer_id").agg(marketing.mean_gap_days(F.min("order_date"), F.max("order_date"), F.count("order_date")).alias("g"))
    assert rows(gaps) == [("A", 0.0)]


def test_first_order_flag_with_null_customer(shop):
    flagged = intermediate.flag_first_orders(shop.stg_orders)
    assert flagged.count() == 8 and rows(flagged.where("customer_id is null"), "is_first_order") == [(False,)]
