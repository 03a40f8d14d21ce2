"""All models wired together over one set of raw tables.

``RetailModels(StagedTables(raw), as_of)`` exposes every model as a lazy attribute. Attributes that need only a part of
a mart read the narrow building block instead of the full mart, so that one query does not compute
joins whose columns it drops; the values are the same (tests compare both).
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, data_science, finance, intermediate, marketing
from .staging import STAGING


class StagedTables:
    """The staging models over one set of raw tables (``raw.raw_orders``, ...) as lazy attributes."""

    def __init__(self, raw):
        self.raw = raw

    def __getattr__(self, name: str) -> DataFrame:
        table = "raw_" + name.removeprefix("stg_")
        if not name.startswith("stg_") or table not in STAGING:
            raise AttributeError(name)
        staged = STAGING[table](getattr(self.raw, table))
        setattr(self, name, staged)
        return staged


class RetailModels:
    """All models over staged tables; ``stg_*`` attributes are those of ``staged``."""

    def __init__(self, staged: StagedTables, as_of: dt.date):
        self.staged = staged
        self.raw = staged.raw
        self.as_of = as_of

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("stg_"):
            return getattr(self.staged, name)
        raise AttributeError(name)

    # Narrow blocks.
    @cached_property
    def order_totals(self) -> DataFrame:
        return intermediate.order_totals(self.stg_orders, self.stg_order_items)

    @cached_property
    def order_amounts(self) -> DataFrame:
        """Order columns of fct_orders without flags, payments and shipments."""
        return core.order_fact(self.order_totals)

    @cached_property
    def order_amounts_first(self) -> DataFrame:
        """``order_amounts`` with the first-order flag."""
        flagged = intermediate.flag_first_orders(self.stg_orders)
        return core.order_fact(intermediate.order_totals(flagged, self.stg_order_items))

    @cached_property
    def order_lines(self) -> DataFrame:
        """fct_order_items without the returned flag."""
        return core.order_lines(self.stg_order_items, self.stg_orders)

    # Intermediate models.
    @cached_property
    def int_orders_enriched(self) -> DataFrame:
        return intermediate.int_orders_enriched(
            self.stg_orders, self.stg_order_items, self.stg_products, self.stg_returns
        )

    @cached_property
    def int_customer_order_summary(self) -> DataFrame:
        return intermediate.int_customer_order_summary(
            self.order_totals, self.stg_orders, self.stg_order_items, self.stg_products, self.stg_returns, self.as_of
        )

    @cached_property
    def int_payment_summary(self) -> DataFrame:
        return intermediate.int_payment_summary(self.stg_payments, self.stg_orders)

    @cached_property
    def int_shipment_summary(self) -> DataFrame:
        return intermediate.int_shipment_summary(self.stg_shipments, self.stg_orders)

    @cached_property
    def int_product_performance(self) -> DataFrame:
        return intermediate.int_product_performance(self.stg_order_items, self.stg_orders, self.stg_returns)

    # Core marts.
    @cached_property
    def dim_customers(self) -> DataFrame:
        return core.dim_customers(self.stg_customers, self.int_customer_order_summary, self.as_of)

    @cached_property
    def dim_products(self) -> DataFrame:
        return core.dim_products(self.stg_products, self.int_product_performance)

    @cached_property
    def catalogue(self) -> DataFrame:
        """dim_products columns that come from the catalogue alone."""
        return self.stg_products.withColumnRenamed("unit_price", "current_price")

    @cached_property
    def tiered_products(self) -> DataFrame:
        """dim_products columns that come from the catalogue and the revenue, without returns."""
        catalogue = self.stg_products.select("product_id", "product_name", "category", "unit_price")
        return core.ranked_products(catalogue, intermediate.product_revenue(self.stg_order_items, self.stg_orders))

    @cached_property
    def dim_date(self) -> DataFrame:
        """Calendar over the span of the orders."""
        return core.dim_date_over(self.stg_orders, "order_date")

    @cached_property
    def fct_orders(self) -> DataFrame:
        return core.fct_orders(self.int_orders_enriched, self.stg_payments, self.stg_shipments)

    @cached_property
    def fct_order_items(self) -> DataFrame:
        return core.fct_order_items(self.stg_order_items, self.stg_orders, self.stg_returns)

    @cached_property
    def fct_payments(self) -> DataFrame:
        return core.fct_payments(self.stg_payments, self.stg_orders)

    # Finance.
    @cached_property
    def fct_revenue(self) -> DataFrame:
        return finance.fct_revenue(self.order_amounts)

    @cached_property
    def fct_refunds(self) -> DataFrame:
        return finance.fct_refunds(self.fct_payments, self.order_amounts)

    @cached_property
    def monthly_revenue_summary(self) -> DataFrame:
        return finance.monthly_revenue_summary(self.order_amounts_first)

    @cached_property
    def product_margin_analysis(self) -> DataFrame:
        return finance.product_margin_analysis(self.catalogue, self.order_lines)

    @cached_property
    def daily_flash_report(self) -> DataFrame:
        return finance.daily_flash_report(self.order_amounts, self.as_of)

    @cached_property
    def country_revenue_breakdown(self) -> DataFrame:
        return finance.country_revenue_breakdown(self.order_amounts, self.as_of)

    # Marketing.
    @cached_property
    def customer_segments(self) -> DataFrame:
        return marketing.customer_segments(self.dim_customers, self.as_of)

    @cached_property
    def customer_ltv(self) -> DataFrame:
        return marketing.customer_ltv(self.dim_customers, self.stg_orders, self.as_of)

    @cached_property
    def cohort_analysis(self) -> DataFrame:
        return marketing.cohort_analysis(self.stg_customers, self.order_amounts)

    @cached_property
    def channel_attribution(self) -> DataFrame:
        return marketing.channel_attribution(self.order_amounts_first, self.stg_customers, self.as_of)

    @cached_property
    def fct_campaign_performance(self) -> DataFrame:
        return marketing.fct_campaign_performance(self.order_amounts, self.as_of)

    # Data science.
    @cached_property
    def customer_features(self) -> DataFrame:
        return data_science.customer_features(self.dim_customers, self.order_amounts, self.as_of)

    @cached_property
    def order_sequence_features(self) -> DataFrame:
        return data_science.order_sequence_features(self.order_amounts)

    @cached_property
    def product_affinity_features(self) -> DataFrame:
        return data_science.product_affinity_features(
            self.order_lines, self.tiered_products, all_lines=self.stg_order_items
        )

    @cached_property
    def churn_prediction_input(self) -> DataFrame:
        return data_science.churn_prediction_input(self.customer_features)

    @cached_property
    def customer_lifetime_value_features(self) -> DataFrame:
        return data_science.customer_lifetime_value_features(self.customer_features, self.stg_orders)

    @cached_property
    def recommendation_input(self) -> DataFrame:
        return data_science.recommendation_input(self.order_lines, self.catalogue, self.as_of)


# Final sort of the report models; a stored table does not need it. ``-`` marks descending.
REPORT_ORDER = {
    "fct_revenue": ["-date_day", "-net_revenue_eur", "channel", "country"],
    "fct_refunds": ["-refund_date", "payment_id"],
    "monthly_revenue_summary": ["year", "month_num"],
    "product_margin_analysis": ["aggregation_level", "category", "-total_revenue_eur", "product_id"],
    "daily_flash_report": ["-date_day"],
    "country_revenue_breakdown": ["-total_revenue_eur", "country"],
    "cohort_analysis": ["signup_cohort_month", "period_number"],
    "channel_attribution": ["-last_touch_revenue_eur", "channel"],
}


def in_report_order(model: str, df: DataFrame) -> DataFrame:
    """``df`` sorted the way the report is read; NULLs last in both directions."""
    keys = [
        F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
        for c in REPORT_ORDER.get(model, [])
    ]
    return df.orderBy(*keys) if keys else df
