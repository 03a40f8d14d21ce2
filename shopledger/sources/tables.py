"""Adapters: the benchmark's star-schema tables presented as the ten raw retail tables.

Each adapter is a row-wise projection of one table (customers also look up the 25-row nation table),
so it adds no shuffle and keeps column pruning and filter pushdown intact.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import code_of
from ..schemas import DOMAINS

# Last order date of the generated tables; the "today" of every registered query.
AS_OF = dt.date(2001, 8, 1)

CHANNEL_OF_SEGMENT = {
    "AUTOMOBILE": "1-URGENT",
    "BUILDING": "2-HIGH",
    "FURNITURE": "3-MEDIUM",
    "HOUSEHOLD": "5-LOW",
    "MACHINERY": "wholesale",
}
MATERIALS = DOMAINS["material"]
METHODS = ["card", "wallet", "giro", "voucher"]
GATEWAYS = ["north_pay", "quick_pay", "desk", "counter"]
CURRENCIES = ["EUR", "gbp", "USD", "CHF", "JPY"]
CARRIERS = ["Northline", "Swiftbox", "Parcelia", "Roadhawk", "Blueways"]
REASONS = ["too_small", "second_thoughts", "other_than_shown", "broken", "received_twice", "poor_finish"]
REFUND_STATES = DOMAINS["refund_status"]
EVENT_OF_TYPE = {
    "click": "add_to_cart",
    "view": "page_view",
    "purchase": "checkout_complete",
    "signup": "product_view",
    "error": "search",
}


def _pick(values: list[str], n: Column) -> Column:
    """values[n mod len]."""
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (n % len(values)).cast("int") + 1)


def _text(c: Column) -> Column:
    return c.cast("string")


def _cents(c: Column) -> Column:
    """Whole cents of a double that holds at most two decimals."""
    return F.floor(c * 100 + 0.5)


def _from_cents(c: Column, to: str = "decimal(10,2)") -> Column:
    # Far cheaper than a cast from double, which goes through text.
    return (c.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast(to)


def _line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


class RetailTables:
    """The ten raw tables over one folder of benchmark parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_customers(self) -> DataFrame:
        key, balance = F.col("c_custkey"), F.col("c_acctbal")
        signup = F.date_add(F.lit("1994-10-01").cast("date"), (key % 900).cast("int"))
        nation = self.table("nation").select("n_nationkey", "n_name")
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                _text(key).alias("customer_id"),
                F.substring("c_name", 1, 8).alias("first_name"),
                F.substring("c_name", 10, 20).alias("last_name"),
                F.concat(F.lit(" "), "c_name", F.lit("@Example.COM ")).alias("email"),
                F.lit(None).cast("string").alias("phone"),
                F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 18000).cast("int")).alias("birth_date"),
                _pick(["M", "F", "Other"], key).alias("gender"),
                F.col("n_name").alias("city"),
                F.col("n_name").alias("country"),
                signup.alias("signup_date"),
                F.when(balance < 2500, "Bronze")
                .when(balance < 5000, "Silver")
                .when(balance < 7500, "Gold")
                .otherwise("Platinum")
                .alias("loyalty_tier"),
                code_of(F.col("c_mktsegment"), CHANNEL_OF_SEGMENT, None).alias("acquisition_channel"),
                signup.cast("timestamp_ntz").alias("_loaded_at"),
            )
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        key, price = F.col("p_partkey"), _from_cents(_cents(F.col("p_retailprice")))
        launched = F.date_add(F.lit("1994-01-01").cast("date"), (key % 365).cast("int"))
        return self.table("part").select(
            _text(key).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("Size "), _text(F.col("p_size"))).alias("subcategory"),
            _pick(MATERIALS, F.col("p_size")).alias("material"),
            F.substring_index("p_name", " ", 1).alias("color"),
            price.alias("unit_price"),
            F.round(price * F.expr("0.35"), 2).cast("decimal(10,2)").alias("cost_price"),
            F.concat(F.lit("SKU-"), _text(key)).alias("sku_code"),
            F.col("p_brand").alias("collection"),
            (key % 10 != 0).alias("is_active"),
            launched.alias("launched_at"),
            launched.cast("timestamp_ntz").alias("_loaded_at"),
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        promo = key % 5 == 0
        return self.table("orders").select(
            _text(key).alias("order_id"),
            _text(F.col("o_custkey")).alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.when(status == "F", F.when(key % 13 == 0, "returned").otherwise("delivered"))
            .when(status == "O", F.when(key % 17 == 0, "cancelled").otherwise("confirmed"))
            .otherwise("pending")
            .alias("order_status"),
            F.col("o_orderpriority").alias("channel"),
            F.concat(F.lit("CITY_"), _text(key % 40)).alias("shipping_city"),
            F.concat(F.lit("NATION_"), _text(F.col("o_custkey") % 25)).alias("shipping_country"),
            _pick(["standard", "express", "pickup"], key).alias("shipping_method"),
            F.when(promo, "PROMO10").otherwise("").alias("discount_code"),
            F.when(promo, F.lit(10)).cast("decimal(10,2)").alias("discount_amount"),
            F.col("o_orderdate").alias("_loaded_at"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        pieces = F.col("l_quantity").cast("bigint")
        # Price per piece in cents, rounded half up in whole numbers.
        unit = F.floor((_cents(F.col("l_extendedprice")) * 2 + pieces) / (pieces * 2))
        return self.table("lineitem").select(
            _line_key().alias("order_item_id"),
            _text(F.col("l_orderkey")).alias("order_id"),
            _text(F.col("l_partkey")).alias("product_id"),
            pieces.cast("decimal(5,0)").alias("quantity"),
            _from_cents(unit).alias("unit_price_at_order"),
            _cents(F.col("l_discount")).cast("decimal(5,2)").alias("discount_pct"),
            F.col("l_shipdate").alias("_loaded_at"),
        )

    @cached_property
    def raw_payments(self) -> DataFrame:
        """One payment per order; every tenth order also has a failed attempt one day earlier."""
        key, failed = F.col("o_orderkey"), F.col("attempt") == 1
        attempts = F.when(key % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        paid_on = F.date_add(F.col("o_orderdate").cast("date"), (key % 7).cast("int"))
        status = code_of(F.col("o_orderstatus"), {"F": "completed", "O": "pending"}, "refunded")
        return (
            self.table("orders")
            .select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", F.explode(attempts).alias("attempt"))
            .select(
                F.concat(F.lit("PAY-"), _text(key), F.when(failed, "-F").otherwise("")).alias("payment_id"),
                _text(key).alias("order_id"),
                F.date_sub(paid_on, F.col("attempt")).alias("payment_date"),
                _pick(METHODS, key).alias("payment_method"),
                _from_cents(_cents(F.col("o_totalprice"))).alias("amount"),
                _pick(CURRENCIES, key).alias("currency"),
                F.when(failed, "failed").otherwise(status).alias("payment_status"),
                _pick(GATEWAYS, key).alias("gateway"),
                F.col("o_orderdate").alias("_loaded_at"),
            )
        )

    @cached_property
    def raw_shipments(self) -> DataFrame:
        """One shipment per order line; open first lines are not shipped yet, open lines not delivered."""
        delivered = F.col("l_linestatus") == "F"
        ship = F.col("l_shipdate").cast("date")
        shipped = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), ship)
        arrival = F.date_add(ship, (F.col("l_quantity").cast("int") % 12))
        return self.table("lineitem").select(
            F.concat(F.lit("SHP-"), _line_key()).alias("shipment_id"),
            _text(F.col("l_orderkey")).alias("order_id"),
            _pick(CARRIERS, F.col("l_suppkey")).alias("carrier"),
            F.concat(F.lit("TRK-"), _line_key()).alias("tracking_number"),
            F.date_add(ship, 5).alias("estimated_delivery_date"),
            shipped.alias("shipped_at"),
            F.when(delivered, _text(arrival)).otherwise("").alias("delivered_at"),
            F.when(delivered, "delivered").otherwise("in_transit").alias("shipment_status"),
            F.col("l_shipdate").alias("_loaded_at"),
        )

    @cached_property
    def raw_returns(self) -> DataFrame:
        ship = F.col("l_shipdate").cast("date")
        return (
            self.table("lineitem")
            .where(F.col("l_returnflag") == "R")
            .select(
                F.concat(F.lit("RET-"), _line_key()).alias("return_id"),
                _text(F.col("l_orderkey")).alias("order_id"),
                F.when(F.col("l_linenumber") == 5, "").otherwise(_line_key()).alias("order_item_id"),
                _pick(REASONS, F.col("l_suppkey")).alias("return_reason"),
                F.date_add(ship, 5).alias("return_requested_at"),
                F.date_add(ship, 12).alias("return_received_at"),
                _from_cents(_cents(F.col("l_extendedprice"))).alias("refund_amount"),
                _pick(REFUND_STATES, F.col("l_linenumber")).alias("refund_status"),
                F.col("l_shipdate").alias("_loaded_at"),
            )
        )

    @cached_property
    def raw_campaigns(self) -> DataFrame:
        key = F.col("s_suppkey")
        start = F.date_add(F.lit("1995-01-01").cast("date"), (key * 11 % 2000).cast("int"))
        return self.table("supplier").select(
            F.concat(F.lit("CAMP_"), _text(key)).alias("campaign_id"),
            F.col("s_name").alias("campaign_name"),
            _pick(["awareness", "acquisition", "retention"], key).alias("campaign_type"),
            _pick(["email", "instagram", "search"], key).alias("channel"),
            start.alias("start_date"),
            F.date_add(start, (key % 60).cast("int")).alias("end_date"),
            F.abs(F.col("s_acctbal")).cast("decimal(12,2)").alias("budget_eur"),
            F.lit("all").alias("target_segment"),
            _pick(["email", "instagram", "google"], key).alias("utm_source"),
            _pick(["lifecycle", "social", "cpc"], key).alias("utm_medium"),
            F.concat(F.lit("campaign_"), _text(key)).alias("utm_campaign"),
            start.cast("timestamp_ntz").alias("_loaded_at"),
        )

    @cached_property
    def raw_campaign_attributions(self) -> DataFrame:
        key = F.col("o_orderkey")
        campaign = F.concat(F.lit("CAMP_"), _text(key % 25))
        return self.table("orders").select(
            F.concat(F.lit("ATT-"), _text(key)).alias("attribution_id"),
            _text(F.col("o_custkey")).alias("customer_id"),
            campaign.alias("campaign_id"),
            _text(key).alias("order_id"),
            F.concat(F.lit("CAMP_"), _text(key % 7)).alias("first_touch_campaign_id"),
            campaign.alias("last_touch_campaign_id"),
            _from_cents(_cents(F.col("o_totalprice"))).alias("attributed_revenue_eur"),
            _pick(["last_touch", "first_touch", "linear"], key).alias("attribution_model"),
            F.col("o_orderdate").alias("_loaded_at"),
        )

    @cached_property
    def raw_web_events(self) -> DataFrame:
        key, user = F.col("event_id"), F.col("user_id")
        browsing = F.col("event_type").isin("view", "error")
        return self.table("events").select(
            _text(key).alias("event_id"),
            F.concat_ws("-", user, F.date_format("ts", "yyyyMMdd")).alias("session_id"),
            F.when(user % 10 == 0, "").otherwise(_text(user)).alias("customer_id"),
            code_of(F.col("event_type"), EVENT_OF_TYPE, None).alias("event_type"),
            F.col("ts").alias("event_timestamp"),
            F.concat(F.lit("/p/"), _text(key % 100)).alias("page_url"),
            F.when(browsing, "").otherwise(_text(key % 1000)).alias("product_id"),
            _pick(["desktop", "mobile", "tablet"], key).alias("device_type"),
            _pick(["firefox", "chrome", "safari", "edge"], key).alias("browser"),
            F.when(key % 2 == 0, "").otherwise("newsletter").alias("utm_source"),
            F.col("ts").alias("_loaded_at"),
        )
