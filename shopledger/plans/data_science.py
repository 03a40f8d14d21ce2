"""Feature tables and model inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.conditions import band_from, code_of, first_match, flag, kept
from ..functions.money import quotient, ratio, rounded, sample_deviation
from ..operators.pairs import top_partners
from ..operators.ranking import most_frequent
from ..operators.sequences import continued, distinct_sizes, sequence_ends, with_previous
from ..sources.sinks import write_table
from .marketing import mean_gap_days

# Fixed values.
TIER_CODES = {"Bronze": 1, "Silver": 2, "Gold": 3, "Platinum": 4}
CHURN_AFTER_DAYS = 180
LTV_TIERS = [(3000, "elite"), (1500, "high"), (600, "medium"), (200, "low")]


def _kept(facts: DataFrame) -> DataFrame:
    return facts.where(kept(F.col("order_status")))


def customer_features(customers: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Recency, frequency, value, spread of order values, preferred channel and profile codes."""
    own = _kept(orders)
    spread = own.groupBy("customer_id").agg(sample_deviation(F.col("net_revenue_eur")).alias("_std"))
    per_channel = own.groupBy("customer_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    preferred = most_frequent(per_channel, "customer_id", "channel", "n", "preferred_channel")
    channels = per_channel.groupBy("customer_id").agg(F.count("channel").alias("_channels"))
    returned, total = F.col("total_items_returned"), F.col("total_orders")
    return (
        customers.join(spread, "customer_id", "left")
        .join(preferred, "customer_id", "left")
        .join(channels, "customer_id", "left")
        .select(
            "customer_id",
            D.day(as_of).alias("snapshot_date"),
            F.col("days_since_last_order").alias("recency_days"),
            F.col("total_orders").alias("frequency_orders"),
            F.col("lifetime_value_eur").alias("monetary_value"),
            F.col("avg_order_value_eur").alias("avg_order_value"),
            F.coalesce("_std", F.lit(0.0)).alias("std_order_value"),
            "preferred_channel",
            F.coalesce("_channels", F.lit(0)).alias("distinct_channels_used"),
            F.col("favorite_category").alias("preferred_category"),
            D.days_between(F.col("signup_date"), D.day(as_of)).alias("days_since_signup"),
            code_of(F.col("loyalty_tier"), TIER_CODES, 0).alias("loyalty_tier_encoded"),
            flag(returned > 0).alias("has_returned_items"),
            F.when(total > 0, ratio(returned, total, 4)).otherwise(0.0).alias("return_rate"),
            flag(F.col("customer_status") == "active").alias("active_flag"),
            "gender",
            "country",
            "acquisition_channel",
            "customer_status",
            "customer_tenure_days",
        )
    )


SEQUENCE = {
    "key": "customer_id",
    "day": "order_date",
    "tie": "order_id",
    "number": "order_number",
    "previous": {"_day": "order_date", "_net": "net_revenue_eur"},
    "distinct": {"_channels": "channel"},
}


def _in_sequence(orders: DataFrame) -> DataFrame:
    return _kept(orders).select("customer_id", "order_id", "order_date", "net_revenue_eur", "channel")


def order_sequence_features(orders: DataFrame, slices: int | None = None) -> DataFrame:
    """Order number, gap, value trend and channel consistency along each customer's kept orders."""
    return _sequence_features(with_previous(_in_sequence(orders), slices=slices, **SEQUENCE))


def start_sequences(orders: DataFrame, root: str) -> None:
    """Number the kept orders of a first batch, and store them with the ends of their sequences under ``root``."""
    rows = with_previous(_in_sequence(orders), **{k: v for k, v in SEQUENCE.items() if k != "distinct"})
    write_table(sequence_ends(write_table(rows, f"{root}/rows/batch=0"), **SEQUENCE), f"{root}/ends/0")


def append_sequences(orders: DataFrame, root: str, batch: int) -> None:
    """Number the kept orders of a later batch (1, 2, ...) on from the stored ends; earlier rows are not read."""
    spark = orders.sparkSession
    ends = spark.read.parquet(f"{root}/ends/{batch - 1}")
    rows, new_ends = continued(ends, write_table(_in_sequence(orders), f"{root}/arrived/{batch}"), **SEQUENCE)
    write_table(rows, f"{root}/rows/batch={batch}")
    write_table(new_ends, f"{root}/ends/{batch}")


def stored_sequence_features(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """``order_sequence_features`` of all batches up to ``batch``, from the stored rows and ends."""
    rows = spark.read.parquet(f"{root}/rows").where(F.col("batch") <= batch).drop("batch")
    sizes = distinct_sizes(spark.read.parquet(f"{root}/ends/{batch}"), "customer_id", SEQUENCE["distinct"])
    return _sequence_features(rows.join(sizes, "customer_id", "left"))


def _sequence_features(sequence: DataFrame) -> DataFrame:
    net, before = F.col("net_revenue_eur"), F.col("_net")
    # Orders without a customer form a sequence but have no customer to count channels for.
    channels = F.when(F.col("customer_id").isNotNull(), F.col("_channels"))
    return sequence.select(
        "customer_id",
        "order_id",
        "order_number",
        "order_date",
        "net_revenue_eur",
        "channel",
        D.days_between(F.col("_day"), F.col("order_date")).alias("days_between_orders"),
        first_match(
            [
                (before.isNull(), "first_order"),
                (net > before * F.lit("1.1").cast("decimal(2,1)"), "growing"),
                (net < before * F.lit("0.9").cast("decimal(2,1)"), "declining"),
            ],
            "stable",
        ).alias("aov_trend"),
        code_of(channels, {1: "consistent", 2: "mixed"}, "omnichannel").alias("channel_consistency"),
        channels.alias("total_distinct_channels"),
    )


def product_affinity_features(
    lines: DataFrame,
    products: DataFrame,
    wide: int | None = None,
    min_rows: int | None = None,
    all_lines: DataFrame | None = None,
) -> DataFrame:
    """Per product the one bought together with it in most kept orders, and its mean basket size."""
    partners = top_partners(_kept(lines), "order_id", "product_id", wide, min_rows, all_lines=all_lines)
    other = products.select(
        F.col("product_id").alias("partner"),
        F.col("product_name").alias("cross_sell_product_name"),
        F.col("category").alias("cross_sell_category"),
    )
    # One product may be the partner of very many others.
    return (
        products.join(partners, "product_id", "left")
        .join(other, "partner", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            "current_price",
            "performance_tier",
            F.col("partner").alias("cross_sell_product_id"),
            "cross_sell_product_name",
            "cross_sell_category",
            F.coalesce("together", F.lit(0)).alias("affinity_score"),
            F.coalesce("mean_group_size", F.lit(1.0)).alias("avg_basket_size_with_product"),
        )
    )


def churn_prediction_input(features: DataFrame) -> DataFrame:
    """Training rows labelled churned after 180 days without an order, or without any order."""
    recency = F.col("recency_days")
    return features.select(
        "customer_id",
        "snapshot_date",
        F.coalesce(recency > CHURN_AFTER_DAYS, F.lit(True)).alias("is_churned"),
        recency.alias("days_since_last_purchase"),
        "frequency_orders",
        "monetary_value",
        "avg_order_value",
        "std_order_value",
        "preferred_channel",
        "distinct_channels_used",
        "preferred_category",
        "days_since_signup",
        "loyalty_tier_encoded",
        "has_returned_items",
        "return_rate",
        "active_flag",
        "gender",
        "country",
        "acquisition_channel",
        "customer_tenure_days",
        F.lit(None).cast("double").alias("predicted_churn_probability_placeholder"),
    )


def customer_lifetime_value_features(features: DataFrame, orders: DataFrame) -> DataFrame:
    """Purchase rhythm per customer; orders shrink to (customer, month) first."""
    monthly = (
        _kept(orders)
        .groupBy("customer_id", D.month_start(F.col("order_date")).alias("month"))
        .agg(
            F.count("order_id").alias("orders"),
            F.min("order_date").alias("lo"),
            F.max("order_date").alias("hi"),
            F.count("order_date").alias("dated"),
        )
    )
    rhythm = (
        monthly.groupBy("customer_id")
        .agg(
            F.count("month").alias("_months"),
            F.sum("orders").alias("_orders"),
            F.min("lo").alias("_lo"),
            F.max("hi").alias("_hi"),
            F.sum("dated").alias("_n"),
        )
        .withColumn("_gap", mean_gap_days(F.col("_lo"), F.col("_hi"), F.col("_n")))
    )
    gap = F.col("_gap")
    return features.join(rhythm, "customer_id", "left").select(
        "customer_id",
        "snapshot_date",
        F.floor(F.col("days_since_signup") / 30).alias("months_since_signup"),
        "customer_tenure_days",
        F.col("frequency_orders").alias("order_count_so_far"),
        F.col("monetary_value").alias("cumulative_revenue_so_far"),
        "avg_order_value",
        F.coalesce(gap, F.lit(0.0)).alias("avg_inter_order_days"),
        F.when(gap > 0, rounded(quotient(F.col("recency_days"), gap) * 100, 1)).alias("pct_of_avg_cycle_elapsed"),
        F.coalesce(quotient(F.col("_orders"), F.col("_months")), F.lit(0.0)).alias("orders_per_active_month"),
        F.coalesce("_months", F.lit(0)).alias("active_purchase_months"),
        "loyalty_tier_encoded",
        "preferred_channel",
        "preferred_category",
        "has_returned_items",
        "return_rate",
        "gender",
        "country",
        "acquisition_channel",
        band_from(F.col("monetary_value"), LTV_TIERS, "very_low").alias("ltv_tier_label"),
    )


def recommendation_input(lines: DataFrame, products: DataFrame, as_of: dt.date) -> DataFrame:
    """Customer-product interactions with an implicit rating, for products of the catalogue."""
    interactions = (
        _kept(lines)
        .groupBy("customer_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("purchase_count"),
            F.sum("quantity").alias("total_units"),
            F.sum("line_revenue_eur").cast("decimal(18,2)").alias("revenue"),
            F.max("order_date").alias("last_purchased_date"),
            F.min("order_date").alias("first_purchased_date"),
        )
    )
    catalogue = products.select("product_id", "product_name", "category")
    return interactions.join(catalogue, "product_id").select(
        "customer_id",
        "product_id",
        "product_name",
        "category",
        "purchase_count",
        "total_units",
        "revenue",
        "last_purchased_date",
        "first_purchased_date",
        rounded(F.ln(F.col("revenue").cast("double") + 1), 4).alias("implicit_rating"),
        D.days_between(F.col("last_purchased_date"), D.day(as_of)).alias("days_since_purchase"),
    )
