"""Staging: rename, cast and clean the raw tables.

All functions are row-wise, so they accept a streaming DataFrame as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import blank_to_null
from ..functions.dates import days_between
from ..functions.money import line_revenue, percent, to_eur


def _as(name: str, to: str = "string") -> Column:
    return F.col(name).cast(to).alias(name)


def _as_date(raw: DataFrame, name: str) -> Column:
    """Date of a column: blank text is NULL, any other text that is no date fails the query."""
    if isinstance(raw.schema[name].dataType, T.DateType):
        return F.col(name)
    text = blank_to_null(F.trim(F.col(name).cast("string")))
    date = text.try_cast("date")
    wrong = F.raise_error(F.concat(F.lit(f"malformed date in {name}: "), text))
    return F.when(text.isNotNull() & date.isNull(), wrong).otherwise(date)


def _date(raw: DataFrame, name: str) -> Column:
    return _as_date(raw, name).alias(name)


def _loaded_at() -> Column:
    return F.col("_loaded_at").cast("timestamp_ntz").alias("loaded_at")


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        _as("customer_id"),
        _as("first_name"),
        _as("last_name"),
        F.trim(F.lower(F.col("email").cast("string"))).alias("email"),
        _as("phone"),
        _date(raw, "birth_date"),
        _as("gender"),
        _as("city"),
        _as("country"),
        _date(raw, "signup_date"),
        _as("loyalty_tier"),
        _as("acquisition_channel"),
        _loaded_at(),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    price, cost = F.col("unit_price").cast("decimal(10,2)"), F.col("cost_price").cast("decimal(10,2)")
    margin = price - cost
    return raw.select(
        _as("product_id"),
        _as("product_name"),
        _as("category"),
        _as("subcategory"),
        _as("material"),
        _as("color"),
        price.alias("unit_price"),
        cost.alias("cost_price"),
        margin.cast("decimal(10,2)").alias("gross_margin"),
        F.when(price > 0, percent(margin, price)).cast("decimal(10,4)").alias("margin_pct"),
        _as("sku_code"),
        _as("collection"),
        _as("is_active", "boolean"),
        _date(raw, "launched_at"),
        _loaded_at(),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    discount = F.coalesce(F.col("discount_amount").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
    return raw.select(
        _as("order_id"),
        _as("customer_id"),
        _date(raw, "order_date"),
        _as("order_status"),
        _as("channel"),
        _as("shipping_city"),
        _as("shipping_country"),
        _as("shipping_method"),
        blank_to_null(F.col("discount_code").cast("string")).alias("discount_code"),
        discount.alias("discount_amount"),
        _loaded_at(),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    quantity = F.col("quantity").cast("decimal(5,0)")
    price = F.col("unit_price_at_order").cast("decimal(10,2)")
    discount = F.coalesce(F.col("discount_pct").cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)"))
    return raw.select(
        _as("order_item_id"),
        _as("order_id"),
        _as("product_id"),
        quantity.alias("quantity"),
        price.alias("unit_price_at_order"),
        discount.alias("discount_pct"),
        line_revenue(quantity, price, discount).alias("line_revenue"),
        _loaded_at(),
    )


def stg_payments(raw: DataFrame) -> DataFrame:
    amount, currency = F.col("amount").cast("decimal(10,2)"), F.col("currency").cast("string")
    return raw.select(
        _as("payment_id"),
        _as("order_id"),
        _date(raw, "payment_date"),
        _as("payment_method"),
        amount.alias("amount"),
        currency.alias("currency"),
        to_eur(amount, currency).alias("amount_eur"),
        _as("payment_status"),
        _as("gateway"),
        _loaded_at(),
    )


def stg_shipments(raw: DataFrame) -> DataFrame:
    delivered = blank_to_null(F.col("delivered_at").cast("string"))
    return raw.select(
        _as("shipment_id"),
        _as("order_id"),
        _as("carrier"),
        _as("tracking_number"),
        _date(raw, "estimated_delivery_date"),
        _date(raw, "shipped_at"),
        delivered.alias("delivered_at_raw"),
        _as_date(raw, "delivered_at").alias("delivered_at"),
        _as("shipment_status"),
        _loaded_at(),
    )


def stg_returns(raw: DataFrame) -> DataFrame:
    return raw.select(
        _as("return_id"),
        _as("order_id"),
        blank_to_null(F.col("order_item_id").cast("string")).alias("order_item_id"),
        _as("return_reason"),
        _date(raw, "return_requested_at"),
        _date(raw, "return_received_at"),
        _as("refund_amount", "decimal(10,2)"),
        _as("refund_status"),
        _loaded_at(),
    )


def stg_campaigns(raw: DataFrame) -> DataFrame:
    start, end = _as_date(raw, "start_date"), _as_date(raw, "end_date")
    return raw.select(
        _as("campaign_id"),
        _as("campaign_name"),
        _as("campaign_type"),
        _as("channel"),
        start.alias("start_date"),
        end.alias("end_date"),
        _as("budget_eur", "decimal(12,2)"),
        _as("target_segment"),
        _as("utm_source"),
        _as("utm_medium"),
        _as("utm_campaign"),
        days_between(start, end).alias("campaign_duration_days"),
        _loaded_at(),
    )


def stg_campaign_attributions(raw: DataFrame) -> DataFrame:
    return raw.select(
        _as("attribution_id"),
        _as("customer_id"),
        _as("campaign_id"),
        _as("order_id"),
        _as("first_touch_campaign_id"),
        _as("last_touch_campaign_id"),
        _as("attributed_revenue_eur", "decimal(10,2)"),
        _as("attribution_model"),
        _loaded_at(),
    )


def stg_web_events(raw: DataFrame) -> DataFrame:
    customer = blank_to_null(F.col("customer_id").cast("string"))
    at = F.col("event_timestamp").cast("timestamp_ntz")
    return raw.select(
        _as("event_id"),
        _as("session_id"),
        customer.alias("customer_id"),
        _as("event_type"),
        at.alias("event_timestamp"),
        at.cast("date").alias("event_date"),
        _as("page_url"),
        blank_to_null(F.col("product_id").cast("string")).alias("product_id"),
        _as("device_type"),
        _as("browser"),
        blank_to_null(F.col("utm_source").cast("string")).alias("utm_source"),
        customer.isNotNull().alias("is_authenticated"),
        _loaded_at(),
    )


STAGING = {
    "raw_customers": stg_customers,
    "raw_products": stg_products,
    "raw_orders": stg_orders,
    "raw_order_items": stg_order_items,
    "raw_payments": stg_payments,
    "raw_shipments": stg_shipments,
    "raw_returns": stg_returns,
    "raw_campaigns": stg_campaigns,
    "raw_campaign_attributions": stg_campaign_attributions,
    "raw_web_events": stg_web_events,
}
