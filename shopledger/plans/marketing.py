"""Marketing marts over the core facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.conditions import band_from, band_up_to, first_match, kept
from ..functions.money import percent, ratio, rounded, zero

# Inclusive upper limits of recency days and order counts, exclusive limits of revenue.
RECENCY_BANDS = [(30, 5), (60, 4), (90, 3), (180, 2)]
FREQUENCY_BANDS = [(0, 1), (1, 2), (3, 3), (6, 4)]
MONETARY_BANDS = [(200, 2), (600, 3), (1500, 4)]

# Lifetime value from which a customer is in the segment.
LTV_SEGMENTS = [(2000, "High LTV"), (600, "Medium LTV")]


def customer_segments(customers: DataFrame, as_of: dt.date) -> DataFrame:
    """Recency, frequency and monetary scores by fixed thresholds; the first matching segment wins."""
    value = F.col("lifetime_value_eur")
    scored = customers.select(
        "customer_id",
        "full_name",
        "email",
        "country",
        "loyalty_tier",
        "acquisition_channel",
        "customer_status",
        F.col("total_orders").alias("order_count"),
        "lifetime_value_eur",
        "days_since_last_order",
        "last_order_date",
        "first_order_date",
        "favorite_category",
        band_up_to(F.col("days_since_last_order"), RECENCY_BANDS, 1).alias("recency_score"),
        band_up_to(F.col("total_orders"), FREQUENCY_BANDS, 5).alias("frequency_score"),
        first_match([(value == 0, 1)] + [(value < limit, s) for limit, s in MONETARY_BANDS], 5).alias(
            "monetary_score"
        ),
    )
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    segments = [
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((r >= 3) & (f >= 3), "Loyal"),
        ((r >= 4) & (f <= 2), "New"),
        ((r >= 3) & (m >= 4), "Potential Loyalist"),
        ((r <= 2) & (f >= 3) & (m >= 3), "At Risk"),
        ((r <= 2) & (f >= 3), "Cant Lose Them"),
        ((r <= 2) & (f <= 2) & (m >= 3), "Hibernating"),
        (r <= 1, "Lost"),
    ]
    return scored.select(
        "*",
        (r + f + m).alias("rfm_total_score"),
        first_match(segments, "Promising").alias("rfm_segment"),
        D.day(as_of).alias("segmented_at"),
    )


def mean_gap_days(first, last, dated):
    """Mean days between consecutive dates: the gaps add up to last - first."""
    return F.when(dated > 1, D.days_between(first, last).cast("double") / (dated - 1))


def customer_ltv(customers: DataFrame, orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Yearly order frequency from the mean gap between kept orders, and 12-month value.

    Without a positive gap the frequency column shows the order count while the value uses 1.
    """
    gaps = (
        orders.where(kept(F.col("order_status")))
        .groupBy("customer_id")
        .agg(F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi"), F.count("order_date").alias("_n"))
        .select("customer_id", mean_gap_days(F.col("_lo"), F.col("_hi"), F.col("_n")).alias("_gap"))
    )
    gap, orders_so_far = F.col("_gap"), F.col("total_orders")
    yearly = F.when(gap > 0, ratio(F.lit(365.0), gap))
    return (
        customers.where(orders_so_far > 0)
        .join(gaps, "customer_id", "left")
        .select(
            "customer_id",
            "full_name",
            "country",
            "loyalty_tier",
            "acquisition_channel",
            "signup_date",
            D.year_month(F.col("first_order_date")).alias("cohort_month"),
            "total_orders",
            "lifetime_value_eur",
            "avg_order_value_eur",
            "days_since_last_order",
            "customer_tenure_days",
            F.coalesce(yearly, orders_so_far.cast("double")).alias("estimated_annual_frequency"),
            rounded(F.col("avg_order_value_eur") * F.coalesce(yearly, F.lit(1.0)), 2).alias("predicted_12m_ltv_eur"),
            band_from(F.col("lifetime_value_eur"), LTV_SEGMENTS, "Low LTV").alias("ltv_segment"),
            D.day(as_of).alias("calculated_at"),
        )
    )


def cohort_analysis(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Retention per signup month and order month; returned orders do not count either.

    Orders shrink to (customer, month) before they meet the customers, so a customer brings one row per
    month and distinct customers are a plain count.
    """
    activity = (
        orders.where(kept(F.col("order_status"), ("cancelled", "pending", "returned")))
        .groupBy("customer_id", D.month_start(F.col("order_date")).alias("ordered"))
        .agg(F.count("order_id").alias("orders"), F.sum("net_revenue_eur").alias("revenue"))
    )
    cohorts = customers.select("customer_id", D.month_start(F.col("signup_date")).alias("joined"))
    sizes = cohorts.groupBy("joined").agg(F.count("customer_id").alias("cohort_base_size"))
    metrics = (
        cohorts.join(activity, "customer_id")
        .groupBy("joined", "ordered")
        .agg(
            F.count("customer_id").alias("active_customers"),
            F.sum("orders").alias("cohort_order_count"),
            F.sum("revenue").cast("decimal(18,2)").alias("cohort_revenue"),
        )
    )
    return metrics.join(sizes, "joined").select(
        D.year_month(F.col("joined")).alias("signup_cohort_month"),
        D.year_month(F.col("ordered")).alias("order_cohort_month"),
        "cohort_base_size",
        "active_customers",
        "cohort_order_count",
        "cohort_revenue",
        percent(F.col("active_customers"), F.col("cohort_base_size")).alias("retention_rate_pct"),
        D.calendar_months_between(F.col("joined"), F.col("ordered")).alias("period_number"),
    )


def channel_attribution(orders: DataFrame, customers: DataFrame, as_of: dt.date) -> DataFrame:
    """Last-touch, first-touch and 50/50 linear revenue of delivered orders per order channel.

    Orders shrink to (customer, channel, first-order flag) once; every later step works on that.
    Channels that only acquire customers are absent.
    """
    touches = (
        orders.where(F.col("order_status") == "delivered")
        .groupBy("customer_id", "channel", "is_first_order")
        .agg(F.sum("net_revenue_eur").alias("net"), F.count("order_id").alias("orders"))
    )
    last = touches.groupBy("channel").agg(F.sum("net").alias("last_net"), F.sum("orders").alias("last_orders"))
    per_customer = touches.groupBy("customer_id", "is_first_order").agg(
        F.sum("net").alias("net"), F.sum("orders").alias("orders")
    )
    is_first = F.col("is_first_order")
    acquired = (
        customers.select("customer_id", F.col("acquisition_channel").alias("channel"))
        .join(per_customer, "customer_id")
        .groupBy("channel")
        .agg(
            F.sum(F.when(is_first, F.col("net"))).alias("first_net"),
            F.sum(F.when(is_first, F.col("orders"))).alias("first_orders"),
            F.sum("net").alias("acquired_net"),
        )
    )
    # Half of an order's revenue goes to its own channel, half to the channel that won the customer. Both
    # credit streams have one row per channel by now, so they are added instead of united and regrouped.
    half = F.lit("0.5").cast("decimal(2,1)")
    credit = F.coalesce(F.col("last_net") * half, F.lit(0)) + F.coalesce(F.col("acquired_net") * half, F.lit(0))
    # One row per channel, so the total over all of them is a window over a handful of rows.
    total = F.sum("last_net").over(Window.partitionBy())
    return last.join(acquired, "channel", "left").select(
        "channel",
        F.coalesce("last_net", zero()).alias("last_touch_revenue_eur"),
        F.col("last_orders").alias("last_touch_orders"),
        F.coalesce("first_net", zero()).alias("first_touch_revenue_eur"),
        F.coalesce("first_orders", F.lit(0)).alias("first_touch_orders"),
        # Orders without a channel take part in no credit.
        F.when(F.col("channel").isNotNull(), credit).otherwise(zero()).alias("linear_revenue_eur"),
        percent(F.coalesce("last_net", zero()), total).alias("last_touch_pct_of_total"),
        D.day(as_of).alias("calculated_at"),
    )


def fct_campaign_performance(orders: DataFrame, as_of: dt.date, spend_share: str = "0.1") -> DataFrame:
    """Delivered orders per channel and week; spend is taken as a fixed share of revenue."""
    weekly = (
        orders.where(F.col("order_status") == "delivered")
        .groupBy(F.col("channel").alias("campaign_id"), D.week_start(F.col("order_date")).alias("week_start"))
        .agg(
            F.count("order_id").alias("conversions"),
            F.sum("net_revenue_eur").cast("decimal(18,2)").alias("attributed_revenue_eur"),
        )
    )
    revenue = F.col("attributed_revenue_eur")
    spend = revenue * F.lit(spend_share).cast("decimal(6,4)")
    return weekly.select(
        "campaign_id",
        "week_start",
        F.lit("last_touch").alias("attribution_model"),
        "conversions",
        "attributed_revenue_eur",
        ratio(revenue, spend).alias("roas"),
        ratio(spend, F.col("conversions")).alias("cpa_eur"),
        D.day(as_of).alias("calculated_at"),
    )
