"""Core marts: dimensions and facts with enforced contracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.conditions import code_of, first_match, flag
from ..functions.money import rounded, zero
from ..operators.selection import Order, tiles
from ..session import fresh_path
from ..schemas import contract
from .intermediate import ENRICHED, payment_rollup, primary_shipments

# Days since the last order up to which a customer is active or at risk.
ACTIVE_DAYS = 90
AT_RISK_DAYS = 365

# Performance tier per revenue quartile.
TIERS = {1: "hero", 2: "core", 3: "niche", 4: "long_tail"}


def to_contract(df: DataFrame, mart: str) -> DataFrame:
    """Columns of the contract in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract(mart)])


def dim_customers(customers: DataFrame, summary: DataFrame, as_of: dt.date) -> DataFrame:
    last = F.col("last_order_date")
    today = D.day(as_of)
    status = first_match(
        [
            (F.col("total_orders").isNull(), "prospect"),
            (last >= F.date_sub(today, ACTIVE_DAYS), "active"),
            (last >= F.date_sub(today, AT_RISK_DAYS), "at_risk"),
        ],
        "churned",
    )
    joined = customers.join(summary, "customer_id", "left").withColumn("customer_status", status)
    return to_contract(
        joined.withColumn("full_name", F.concat("first_name", F.lit(" "), "last_name"))
        .withColumn("age", D.calendar_years_between(F.col("birth_date"), today))
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
        .withColumn("lifetime_value_eur", F.coalesce("total_revenue", zero()))
        .withColumn("avg_order_value_eur", F.coalesce("avg_order_value", F.lit(0.0)))
        .withColumn("total_items_returned", F.coalesce("total_items_returned", F.lit(0))),
        "dim_customers",
    )


def ranked_products(products: DataFrame, sales: DataFrame, local_rows: int | None = None) -> DataFrame:
    """Catalogue plus the columns of ``sales``, with a tier by revenue quartile (ties by product id)."""
    joined = (
        products.join(sales, "product_id", "left")
        .withColumnRenamed("unit_price", "current_price")
        .withColumn("total_revenue", F.coalesce("total_revenue", zero()))
    )
    path = fresh_path(joined.sparkSession, "ranked-products")
    ranked = tiles(joined, path, Order(("-total_revenue", "product_id")), len(TIERS), "_quartile", local_rows)
    return ranked.withColumn("performance_tier", code_of(F.col("_quartile"), TIERS, "unranked")).drop("_quartile")


def dim_products(products: DataFrame, performance: DataFrame, local_rows: int | None = None) -> DataFrame:
    """Catalogue plus sales and returns, with a tier by revenue quartile (ties by product id)."""
    ranked = (
        ranked_products(products, performance, local_rows)
        .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))
        .withColumn("total_units_sold", F.coalesce("total_units_sold", F.lit(0)))
        .withColumn("return_rate", F.coalesce("return_rate", F.lit(0.0)))
        .withColumn("avg_days_to_return", rounded(F.col("avg_days_to_return"), 2))
    )
    return to_contract(ranked, "dim_products")


def calendar(days: DataFrame, column: str = "date_day") -> DataFrame:
    """Calendar attributes of the dates in ``column``."""
    d = F.col(column)
    return days.select(
        d.alias("date_day"),
        D.date_key(d).alias("date_key"),
        D.day_of_week(d).alias("day_of_week"),
        F.dayname(d).alias("day_name"),
        F.month(d).alias("month_num"),
        F.monthname(d).alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        D.is_weekend(d).alias("is_weekend"),
        (~D.is_weekend(d)).alias("is_weekday"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofyear(d).alias("day_of_year"),
        (F.dayofmonth(d) == 1).alias("is_first_day_of_month"),
        (d == F.last_day(d)).alias("is_last_day_of_month"),
        D.fiscal_quarter(d).alias("fiscal_quarter"),
        D.fiscal_year(d).alias("fiscal_year"),
        D.season(d).alias("season"),
        D.year_month(d).alias("year_month"),
        F.date_format(d, "yyyy").alias("year_str"),
    )


def dim_date(spark: SparkSession, start: dt.date = dt.date(2022, 1, 1), days: int = 1826) -> DataFrame:
    """Consecutive calendar days from ``start``."""
    first, last = D.day(start), D.day(start + dt.timedelta(days=days - 1))
    return calendar(spark.range(1).select(F.explode(F.sequence(first, last)).alias("date_day")))


def dim_date_over(facts: DataFrame, column: str) -> DataFrame:
    """Every day between the first and the last date of a fact."""
    bounds = facts.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return calendar(bounds.select(F.explode(F.sequence("lo", "hi")).alias("date_day")))


MART_NAMES = {
    "gross_revenue": "gross_revenue_eur",
    "discount_amount": "discount_amount_eur",
    "net_revenue": "net_revenue_eur",
}


def order_fact(enriched: DataFrame) -> DataFrame:
    """Order columns of ``fct_orders`` that come from the order itself, under their mart names."""
    return enriched.withColumnsRenamed(MART_NAMES)


def enriched_orders(fact: DataFrame) -> DataFrame:
    """``int_orders_enriched`` out of a stored ``fct_orders``, which has all of its columns."""
    block = fact.withColumnsRenamed({mart: own for own, mart in MART_NAMES.items()})
    discount = F.col("discount_amount").cast("decimal(10,2)")
    block = block.withColumn("discount_amount", discount).withColumn("discount_amount_hdr", F.col("discount_amount"))
    return block.select(*ENRICHED)


def fct_orders(
    enriched: DataFrame, payments: DataFrame, shipments: DataFrame, late_after_days: int = 7
) -> DataFrame:
    """One row per order with payment and shipment state.

    ``payments`` and ``shipments`` are the staging tables: both shrink to one row per order, and the
    order date is at hand here, so orders are not joined again for their dates. All joins share the
    partitioning by order id.
    """
    paid = payment_rollup(payments).select(
        "order_id", "payment_method", "payment_status", "total_paid_eur", "is_refunded"
    )
    shipped = primary_shipments(
        shipments, late_after_days, ["carrier", "shipment_status", "shipped_at", "delivered_at"]
    ).drop("delivered_at")
    days_to_ship = D.days_between(F.col("order_date"), F.col("shipped_at"))
    joined = (
        order_fact(enriched)
        .join(paid, "order_id", "left")
        .join(shipped, "order_id", "left")
        .withColumn("order_date_key", D.date_key(F.col("order_date")))
        .withColumn("payment_method", F.coalesce("payment_method", F.lit("unknown")))
        .withColumn("payment_status", F.coalesce("payment_status", F.lit("unknown")))
        .withColumn("days_to_ship", F.coalesce(days_to_ship, F.lit(0)))
        .withColumn("is_late_delivery", flag(F.col("is_late_delivery")))
    )
    return to_contract(joined, "fct_orders")


def order_lines(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with their order's customer, date and status; items of unknown orders are dropped."""
    owners = orders.select("order_id", "customer_id", "order_date", "order_status")
    return (
        items.join(owners, "order_id")
        .withColumnRenamed("unit_price_at_order", "unit_price_eur")
        .withColumnRenamed("line_revenue", "line_revenue_eur")
        .withColumn("quantity", F.col("quantity").cast("bigint"))
    )


def fct_order_items(items: DataFrame, orders: DataFrame, returns: DataFrame) -> DataFrame:
    """One row per item; ``has_been_returned`` ignores rejected returns."""
    returned = (
        returns.where((F.col("refund_status") != "rejected") & F.col("order_item_id").isNotNull())
        .select("order_item_id")
        .distinct()
        .withColumn("has_been_returned", F.lit(True))
    )
    return _with_returned(order_lines(items, orders).join(returned, "order_item_id", "left"))


def _with_returned(joined: DataFrame) -> DataFrame:
    return to_contract(
        joined.withColumn("has_been_returned", flag(F.col("has_been_returned"))), "fct_order_items"
    )


def fct_order_items_by_order(items: DataFrame, orders: DataFrame, returned: DataFrame) -> DataFrame:
    """``fct_order_items`` with the returned items known by order and item, each pair once.

    With ``BY_ORDER`` set, items meet both their order and their returns in one shuffle by order.
    """
    marks = returned.select("order_id", "order_item_id").withColumn("has_been_returned", F.lit(True))
    return _with_returned(order_lines(items, orders).join(marks, ["order_id", "order_item_id"], "left"))


# Rows that lie by order can be joined by order and item as they are.
BY_ORDER = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def fct_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    owners = orders.select("order_id", "customer_id", "order_date")
    joined = (
        payments.join(owners, "order_id", "left")
        .withColumnRenamed("amount", "amount_original")
        .withColumn("is_refunded", flag(F.col("payment_status") == "refunded"))
        .withColumn("days_to_payment", D.days_between(F.col("order_date"), F.col("payment_date")))
    )
    return to_contract(joined, "fct_payments")
