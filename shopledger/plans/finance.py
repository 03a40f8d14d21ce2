"""Finance marts over the core facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.conditions import kept
from ..functions.money import growth, mean, mean_units, money, percent, quotient, zero
from ..operators.trailing import running_sum


def _kept(facts: DataFrame) -> DataFrame:
    return facts.where(kept(F.col("order_status")))


def fct_revenue(orders: DataFrame) -> DataFrame:
    """Revenue per day, channel and country with month-to-date and year-to-date sums.

    ``order_id`` is the key of the fact, so counting it counts distinct orders. The running sums see at
    most 366 rows per group.
    """
    daily = (
        _kept(orders)
        .groupBy(F.col("order_date").alias("date_day"), "channel", F.col("shipping_country").alias("country"))
        .agg(
            F.count("order_id").alias("order_count"),
            money(F.sum("gross_revenue_eur")).alias("gross_revenue_eur"),
            money(F.sum("discount_amount_eur")).alias("discount_eur"),
            money(F.sum("net_revenue_eur")).alias("net_revenue_eur"),
            mean(F.col("net_revenue_eur")).alias("avg_order_value_eur"),
        )
    )
    d = F.col("date_day")
    return daily.withColumns(
        {
            "cumulative_mtd_revenue": running_sum(
                "net_revenue_eur", ["channel", "country", D.month_start(d)], "date_day"
            ),
            "cumulative_ytd_revenue": running_sum(
                "net_revenue_eur", ["channel", "country", D.year_start(d)], "date_day"
            ),
        }
    )


def fct_refunds(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Refunded payments with their order and the refund rate of the month.

    Refunds count in the month of payment, revenue in the month of the order, over all statuses. Both
    monthly tables have one row per calendar month, which bounds the broadcasts.
    """
    refunds = payments.where(F.col("is_refunded") | (F.col("payment_status") == "refunded")).select(
        "payment_id", "order_id", "customer_id", "payment_date", "order_date", "amount_eur"
    )
    per_month = refunds.groupBy(D.month_start(F.col("payment_date")).alias("paid_month")).agg(
        F.count("payment_id").alias("monthly_refund_count"),
        F.sum("amount_eur").alias("monthly_total_refunds_eur"),
    )
    revenue = orders.groupBy(D.month_start(F.col("order_date")).alias("ordered_month")).agg(
        F.sum("net_revenue_eur").alias("month_revenue")
    )
    owners = orders.select("order_id", "channel", "shipping_country", "order_status")
    return (
        refunds.join(owners, "order_id", "left")
        .withColumn("paid_month", D.month_start(F.col("payment_date")))
        .withColumn("ordered_month", D.month_start(F.col("order_date")))
        .join(per_month, "paid_month", "left")
        .join(revenue, "ordered_month", "left")
        .select(
            "payment_id",
            "order_id",
            "customer_id",
            F.col("payment_date").alias("refund_date"),
            "order_date",
            "channel",
            "shipping_country",
            "order_status",
            F.col("amount_eur").alias("refund_amount_eur"),
            D.days_between(F.col("order_date"), F.col("payment_date")).alias("days_to_refund"),
            "monthly_refund_count",
            "monthly_total_refunds_eur",
            percent(F.col("monthly_total_refunds_eur"), F.col("month_revenue")).alias("monthly_refund_rate_pct"),
        )
    )


def monthly_revenue_summary(orders: DataFrame) -> DataFrame:
    """Revenue per month, new against returning customers, growth to last month and 12 rows back.

    Orders first shrink to (month, customer, first-order flag); distinct customers are then counted
    over far fewer rows. The lag window holds one row per month.
    """
    net, first = F.col("net_revenue_eur"), F.col("is_first_order")
    per_customer = (
        _kept(orders)
        .groupBy(D.month_start(F.col("order_date")).alias("month"), "customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum(net).alias("net"),
            F.count(net).alias("priced"),
            F.sum(F.when(first, net).otherwise(zero())).alias("new_net"),
            F.sum(F.when(~first, net).otherwise(zero())).alias("old_net"),
            F.count_if(first).alias("new_orders"),
            F.count_if(~first).alias("old_orders"),
        )
    )
    monthly = per_customer.groupBy("month").agg(
        F.sum("orders").alias("total_orders"),
        money(F.sum("net")).alias("revenue_eur"),
        quotient(F.sum("net"), F.sum("priced")).alias("avg_order_value_eur"),
        F.count("customer_id").alias("active_customers"),
        F.sum("new_orders").alias("new_customers"),
        F.sum("old_orders").alias("returning_customers"),
        money(F.sum("new_net")).alias("new_customer_revenue_eur"),
        money(F.sum("old_net")).alias("returning_customer_revenue_eur"),
    )
    timeline = Window.orderBy("month")
    revenue, count = F.col("revenue_eur"), F.col("total_orders")
    return monthly.select(
        D.year_month(F.col("month")).alias("year_month"),
        F.year("month").alias("year"),
        F.month("month").alias("month_num"),
        *[c for c in monthly.columns if c != "month"],
        growth(revenue, F.lag(revenue).over(timeline)).alias("mom_revenue_growth_pct"),
        growth(revenue, F.lag(revenue, 12).over(timeline)).alias("yoy_revenue_growth_pct"),
        growth(count, F.lag(count).over(timeline)).alias("mom_orders_growth_pct"),
    )


UNIT_PLACES = 8  # decimals of a product's mean price, of which a category shows the mean


def product_margin_analysis(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Realised margin per product, plus one subtotal row per category.

    Items shrink to (product, order) and then to one row per product; cost is units times unit cost, so
    no item meets the product table. Detail and subtotals are grouping sets over these rows, so the items are
    read once. Category averages are unweighted averages of the product rows.
    """
    per_order = (
        _kept(lines)
        .groupBy("product_id", "order_id")
        .agg(
            F.sum("quantity").alias("units"),
            F.sum("line_revenue_eur").alias("revenue"),
            F.sum("unit_price_eur").alias("prices"),
            F.count("unit_price_eur").alias("priced"),
        )
    )
    prices, priced = F.sum("prices"), F.sum("priced")
    sold = per_order.groupBy("product_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("units").alias("units_sold"),
        money(F.sum("revenue")).alias("total_revenue_eur"),
        quotient(prices, priced).alias("_price"),
        mean_units(prices, priced, UNIT_PLACES).alias("_price_units"),
    )
    unit = 10**UNIT_PLACES
    product = (
        products.select("product_id", "product_name", "category", "subcategory", "collection", "current_price", "cost_price", "margin_pct")
        .join(sold, "product_id", "left")
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
        .withColumn("total_cost_eur", F.coalesce(money(F.col("units_sold") * F.col("cost_price")), zero()))
        .withColumn("units_sold", F.coalesce("units_sold", F.lit(0)))
        .withColumn("total_revenue_eur", F.coalesce("total_revenue_eur", zero()))
        .withColumn("gross_margin_eur", money(F.col("total_revenue_eur") - F.col("total_cost_eur")))
        .withColumn("_price", F.coalesce("_price", F.col("current_price").cast("double")))
        .withColumn("_price_units", F.coalesce("_price_units", (F.col("current_price") * unit).cast("bigint")))
    )
    keys = ["product_id", "product_name", "subcategory", "collection"]
    levels = product.groupingSets([[*keys, "category"], ["category"]], *keys, "category")
    is_product = F.grouping("product_id") == 0

    def plain_mean(name):
        return mean(F.col(name).cast("decimal(28,8)")).alias(name)

    summed = levels.agg(
        F.when(is_product, "product").otherwise("category").alias("aggregation_level"),
        plain_mean("current_price"),
        plain_mean("cost_price"),
        mean(F.col("margin_pct").cast("decimal(28,8)")).alias("catalog_margin_pct"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("units_sold").alias("units_sold"),
        money(F.sum("total_revenue_eur")).alias("total_revenue_eur"),
        money(F.sum("total_cost_eur")).alias("total_cost_eur"),
        money(F.sum("gross_margin_eur")).alias("gross_margin_eur"),
        # A product has one row, whose own price it shows.
        F.max("_price").alias("_price"),
        (mean(F.col("_price_units").cast("decimal(28,0)")) / unit).alias("_mean_price"),
    )
    detail, revenue = F.col("aggregation_level") == "product", F.col("total_revenue_eur")
    realised = percent(F.col("gross_margin_eur"), revenue)
    return summed.select(
        "product_id",
        "product_name",
        "category",
        "subcategory",
        "collection",
        "current_price",
        "cost_price",
        "catalog_margin_pct",
        "total_orders",
        "units_sold",
        "total_revenue_eur",
        "total_cost_eur",
        "gross_margin_eur",
        F.when(detail & ~F.coalesce(revenue > 0, F.lit(False)), F.col("catalog_margin_pct")).otherwise(realised).alias("realized_margin_pct"),
        F.when(detail, F.col("_price")).otherwise(F.col("_mean_price")).alias("avg_selling_price_eur"),
        "aggregation_level",
    )


def daily_flash_report(orders: DataFrame, as_of: dt.date, days_back: int = 30) -> DataFrame:
    """Days from ``as_of - days_back`` on, against the same date a year earlier.

    The scan is limited to the days that can appear on either side. Days without orders do not appear.
    """
    since = F.date_sub(D.day(as_of), days_back)
    daily = (
        _kept(orders)
        .where(F.col("order_date") >= D.one_year_earlier(since))
        .groupBy(F.col("order_date").alias("date_day"))
        .agg(
            F.count("order_id").alias("orders"),
            money(F.sum("net_revenue_eur")).alias("revenue_eur"),
            mean(F.col("net_revenue_eur")).alias("aov_eur"),
        )
    )
    before = daily.select(
        F.col("date_day").alias("py_day"),
        F.col("orders").alias("py_orders"),
        F.col("revenue_eur").alias("py_revenue_eur"),
        F.col("aov_eur").alias("py_aov_eur"),
    )
    return (
        daily.where(F.col("date_day") >= since)
        .join(before, F.col("py_day") == D.one_year_earlier(F.col("date_day")), "left")
        .select(
            "date_day",
            "orders",
            "revenue_eur",
            "aov_eur",
            F.coalesce("py_orders", F.lit(0)).alias("py_orders"),
            F.coalesce("py_revenue_eur", zero()).alias("py_revenue_eur"),
            F.coalesce("py_aov_eur", F.lit(0.0)).alias("py_aov_eur"),
            growth(F.col("revenue_eur"), F.col("py_revenue_eur")).alias("revenue_vs_py_pct"),
            growth(F.col("orders"), F.col("py_orders")).alias("orders_vs_py_pct"),
        )
    )


def country_revenue_breakdown(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """This year's revenue per country with its share and growth over the whole prior year.

    One pass over the two years; countries without an order this year do not appear. The share is taken
    over one row per country.
    """
    date, net = F.col("order_date"), F.col("net_revenue_eur")
    now, before = D.in_year_of(date, as_of), D.in_year_of(date, as_of, 1)
    per_country = (
        _kept(orders)
        .where((date >= D.day(dt.date(as_of.year - 1, 1, 1))) & (date <= D.day(dt.date(as_of.year, 12, 31))))
        .groupBy(F.col("shipping_country").alias("country"))
        .agg(
            F.count_if(now).alias("rows"),
            F.count(F.when(now, F.col("order_id"))).alias("total_orders"),
            money(F.sum(F.when(now, net))).alias("total_revenue_eur"),
            # A NULL country matches no prior year in an equality join.
            F.coalesce(
                F.when(F.col("country").isNotNull(), money(F.sum(F.when(before, net)))), zero()
            ).alias("py_revenue_eur"),
        )
        .where(F.col("rows") > 0)
    )
    everywhere = F.sum("total_revenue_eur").over(Window.partitionBy())
    revenue, prior = F.col("total_revenue_eur"), F.col("py_revenue_eur")
    return per_country.select(
        "country",
        "total_orders",
        "total_revenue_eur",
        percent(revenue, everywhere).alias("pct_of_total_revenue"),
        "py_revenue_eur",
        growth(revenue, prior).alias("yoy_growth_pct"),
    )
