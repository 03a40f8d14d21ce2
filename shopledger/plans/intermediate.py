"""Order-, customer- and product-level building blocks.

Facts are aggregated to their join key before every join, so a key with very many rows arrives at the
join as one row (or one row per category, product or day).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import flag, kept
from ..functions.dates import day, days_between
from ..functions.money import mean, money, percent, quotient, zero
from ..operators.labels import LabelList, known_labels
from ..operators.ranking import earliest, most_frequent


def flag_first_orders(orders: DataFrame) -> DataFrame:
    """Orders plus ``is_first_order``: placed on the customer's earliest order date (ties all count).

    The earliest dates join on (customer, date), not on customer: only rows of that date match, and a
    customer with very many orders stays spread over its dates.
    """
    first = (
        orders.groupBy("customer_id")
        .agg(F.min("order_date").alias("order_date"))
        .withColumn("is_first_order", F.lit(True))
    )
    return orders.join(first, ["customer_id", "order_date"], "left").withColumn(
        "is_first_order", flag(F.col("is_first_order"))
    )


def order_totals(orders: DataFrame, items: DataFrame, *extra_item_columns) -> DataFrame:
    """Orders with item count, quantity, gross and net revenue; orders without items get zeros.

    ``extra_item_columns`` are further aggregates over the items of an order.
    """
    per_order = items.groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        money(F.sum("line_revenue")).alias("gross_revenue"),
        *extra_item_columns,
    )
    return (
        orders.join(per_order, "order_id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .withColumn("total_quantity", F.coalesce("total_quantity", F.lit(0)))
        .withColumn("gross_revenue", F.coalesce("gross_revenue", zero()))
        .withColumn("net_revenue", money(F.col("gross_revenue") - F.col("discount_amount")))
    )


ENRICHED = [
    "order_id",
    "customer_id",
    "order_date",
    "channel",
    "order_status",
    "shipping_country",
    "shipping_method",
    "discount_code",
    "discount_amount",
    "item_count",
    "total_quantity",
    "gross_revenue",
    "discount_amount_hdr",
    "net_revenue",
    "product_categories",
    "has_returned",
    "is_first_order",
]


def int_orders_enriched(orders: DataFrame, items: DataFrame, products: DataFrame, returns: DataFrame) -> DataFrame:
    """One row per order: item totals, categories, net revenue, returned and first-order flags."""
    categories = LabelList(known_labels(products, "category"))
    coded = products.select("product_id", categories.encode(F.col("category")).alias("category"))
    with_category = items.join(coded, "product_id", "left")
    combined = categories.combine(F.col("category")).alias("categories")
    returned = returns.select("order_id").distinct().withColumn("has_returned", F.lit(True))
    return (
        order_totals(flag_first_orders(orders), with_category, combined)
        .join(returned, "order_id", "left")
        .withColumn("discount_amount_hdr", F.col("discount_amount"))
        .withColumn("product_categories", categories.text(F.col("categories")))
        .withColumn("has_returned", flag(F.col("has_returned")))
        .select(*ENRICHED)
    )


def favorite_categories(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Per customer the category with most items in kept orders, ties to the smallest name."""
    per_order = (
        items.join(products.select("product_id", "category"), "product_id")
        .groupBy("order_id", "category")
        .agg(F.count("order_item_id").alias("n"))
    )
    owners = orders.where(kept(F.col("order_status"))).select("order_id", "customer_id")
    counts = owners.join(per_order, "order_id").groupBy("customer_id", "category").agg(F.sum("n").alias("n"))
    return most_frequent(counts, "customer_id", "category", "n", "favorite_category")


def favorite_categories_of_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """``favorite_categories`` out of ``fct_order_items``, whose rows know their customer: they meet the products alone."""
    known = F.when(F.col("order_item_id").isNotNull(), F.lit(1)).alias("known")  # as good as the item's id to count by
    sold = lines.where(kept(F.col("order_status"))).select("customer_id", "product_id", known)
    counts = (
        sold.join(products.select("product_id", "category"), "product_id")
        .groupBy("customer_id", "category")
        .agg(F.count("known").alias("n"))
    )
    return most_frequent(counts, "customer_id", "category", "n", "favorite_category")


def int_customer_order_summary(
    enriched: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    as_of: dt.date,
    lines: DataFrame | None = None,
) -> DataFrame:
    """One row per customer with kept orders. ``enriched`` needs the columns of ``order_totals``.

    Returns count over all orders of the customer, whatever their status. ``lines`` is a stored ``fct_order_items`` of the
    same items and orders, if there is one.
    """
    favorites = favorite_categories(orders, items, products) if lines is None else favorite_categories_of_lines(lines, products)
    summary = (
        enriched.where(kept(F.col("order_status")))
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            money(F.sum("net_revenue")).alias("total_revenue"),
            mean(F.col("net_revenue")).alias("avg_order_value"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    returns_per_order = returns.groupBy("order_id").agg(F.count("return_id").alias("n"))
    returned = (
        orders.select("order_id", "customer_id")
        .join(returns_per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("n").alias("total_items_returned"))
    )
    return (
        summary.join(favorites, "customer_id", "left")
        .join(returned, "customer_id", "left")
        .select(
            "customer_id",
            "total_orders",
            "total_revenue",
            "avg_order_value",
            "first_order_date",
            "last_order_date",
            days_between(F.col("last_order_date"), day(as_of)).alias("days_since_last_order"),
            days_between(F.col("first_order_date"), day(as_of)).alias("customer_tenure_days"),
            "favorite_category",
            F.coalesce("total_items_returned", F.lit(0)).alias("total_items_returned"),
        )
    )


def payment_rollup(payments: DataFrame) -> DataFrame:
    """One row per order from payments alone. ``payment_status`` is the alphabetically last status."""
    status = F.col("payment_status")
    completed, refunded = status == "completed", status == "refunded"
    return payments.groupBy("order_id").agg(
        money(F.sum(F.when(completed, F.col("amount_eur")).otherwise(zero()))).alias("total_paid_eur"),
        F.max(F.when(completed, F.col("payment_method"))).alias("payment_method"),
        F.max(F.when(completed, F.col("gateway"))).alias("gateway"),
        F.max(status).alias("payment_status"),
        F.count_if(refunded).alias("refund_count"),
        money(F.sum(F.when(refunded, F.col("amount_eur")).otherwise(zero()))).alias("total_refunded_eur"),
        (F.count_if(refunded) > 0).alias("is_refunded"),
        F.max("payment_date").alias("latest_payment_date"),
    )


def int_payment_summary(payments: DataFrame, orders: DataFrame) -> DataFrame:
    dates = orders.select("order_id", "order_date")
    return (
        payment_rollup(payments)
        .join(dates, "order_id", "left")
        .withColumn("days_to_payment", days_between(F.col("order_date"), F.col("latest_payment_date")))
        .drop("order_date", "latest_payment_date")
    )


SHIPMENT_COLUMNS = [
    "shipment_id",
    "carrier",
    "tracking_number",
    "shipment_status",
    "shipped_at",
    "delivered_at",
    "estimated_delivery_date",
]


def primary_shipments(
    shipments: DataFrame, late_after_days: int = 7, columns: list[str] = SHIPMENT_COLUMNS
) -> DataFrame:
    """The earliest shipment per order (unshipped ones last, ties by id) with its delivery time.

    ``columns`` are the shipment columns to carry; they must include both dates.
    """
    travel = days_between(F.col("shipped_at"), F.col("delivered_at"))
    return (
        earliest(shipments, "order_id", ["shipped_at", "shipment_id"], columns)
        .withColumn("days_to_deliver", travel)
        .withColumn("is_late_delivery", flag(F.col("days_to_deliver") > late_after_days))
    )


def int_shipment_summary(shipments: DataFrame, orders: DataFrame, late_after_days: int = 7) -> DataFrame:
    return (
        primary_shipments(shipments, late_after_days)
        .join(orders.select("order_id", "order_date"), "order_id", "left")
        .select(
            "order_id",
            *SHIPMENT_COLUMNS,
            days_between(F.col("order_date"), F.col("shipped_at")).alias("days_to_ship"),
            "days_to_deliver",
            days_between(F.col("order_date"), F.col("delivered_at")).alias("total_fulfillment_days"),
            "is_late_delivery",
        )
    )


def _epoch_day(d):
    return F.unix_date(d).cast("bigint")


def _kept_dates(orders: DataFrame) -> DataFrame:
    return orders.where(kept(F.col("order_status"))).select("order_id", "order_date")


def product_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per product sold in kept orders: orders, units, revenue, first and last day.

    Items meet their order first, so that they are shuffled once: rows that lie by order can be counted by order and
    product as they are. The planner splits a very large order. Each row of an order is told apart, so that the distinct
    order count is a plain count.
    """
    placed = _kept_dates(orders).withColumn("_row", F.monotonically_increasing_id())
    sold = items.select("order_id", "product_id", "quantity", "line_revenue")
    return (
        placed.join(sold, "order_id")
        .groupBy("order_id", "_row", "order_date", "product_id")
        .agg(F.sum("quantity").alias("units"), F.sum("line_revenue").alias("revenue"))
        .groupBy("product_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("units").cast("bigint").alias("total_units_sold"),
            money(F.sum("revenue")).alias("total_revenue"),
            F.min("order_date").alias("first_sold_date"),
            F.max("order_date").alias("last_sold_date"),
        )
    )


def product_revenue(items: DataFrame, orders: DataFrame) -> DataFrame:
    """``product_sales`` with the revenue alone, for which orders need not be told apart."""
    sold = _kept_dates(orders).select("order_id").join(items.select("order_id", "product_id", "line_revenue"), "order_id")
    return sold.groupBy("product_id").agg(money(F.sum("line_revenue")).alias("total_revenue"))


def returns_per_item(returns: DataFrame) -> DataFrame:
    """One row per returned item id: returns, those with a day, the sum of the days' numbers, any that is not rejected.

    Return days are summed as day numbers, so returns shrink to their item before they meet it.
    """
    return (
        returns.where(F.col("order_item_id").isNotNull())
        .groupBy("order_item_id")
        .agg(
            F.count("return_id").alias("n"),
            F.count("return_requested_at").alias("dated"),
            F.sum(_epoch_day(F.col("return_requested_at"))).alias("day_sum"),
            flag(F.max(F.col("refund_status") != "rejected")).alias("accepted"),
        )
    )


ITEM_KEYS = ["order_item_id", "order_id", "product_id"]


def returned_items(items: DataFrame, returns: DataFrame) -> DataFrame:
    """The keys of each item row that has returns, with the columns of ``returns_per_item``."""
    return items.select(*ITEM_KEYS).join(returns_per_item(returns), "order_item_id")


def _product_returns(found: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per product returned from kept orders: returns and mean days to return. ``found`` are ``returned_items``."""
    found = found.select("order_id", "product_id", "n", "dated", "day_sum")
    waited = F.col("day_sum") - F.col("dated") * _epoch_day(F.col("order_date"))
    return (
        _kept_dates(orders)
        .join(found, "order_id")
        .groupBy("product_id")
        .agg(
            F.sum("n").alias("return_count"),
            quotient(
                F.sum(waited), F.sum(F.when(F.col("order_date").isNotNull(), F.col("dated")))
            ).alias("avg_days_to_return"),
        )
    )


def int_product_performance(
    items: DataFrame, orders: DataFrame, returns: DataFrame, found: DataFrame | None = None
) -> DataFrame:
    """One row per product sold in kept orders: sales, returns of its items, days to return.

    ``found`` are the stored ``returned_items`` of ``items`` and ``returns``, if there are.
    """
    found = returned_items(items, returns) if found is None else found
    sales, returned = product_sales(items, orders), _product_returns(found, orders)
    count = F.coalesce("return_count", F.lit(0))
    rate = F.when(F.col("total_units_sold") > 0, percent(count, F.col("total_units_sold"))).otherwise(0.0)
    return sales.join(returned, "product_id", "left").select(
        *sales.columns, count.alias("return_count"), rate.alias("return_rate"), "avg_days_to_return"
    )
