"""Building and storing the platform marts, and reading them back for the consumer marts.

Stored tables cut the lineage: the order block and the facts are computed once and every consumer reads
files, with column pruning, instead of recomputing joins.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..quality import RuleLog, check, enforce_contract, rules_of, tag_personal
from ..session import fresh_path, limit, settings
from ..sources.layout import write_bucketed
from ..sources.monthly import read_months, upsert_months
from ..sources.sinks import write_as_stored, write_clustered, write_table
from . import core, data_science, finance, intermediate, marketing
from .staging import STAGING


# Marts whose plan ends with a shuffle by their key, so that repeated keys are counted while they are written. For
# the others the key column alone is read once more, which moves less than their whole rows would.
BY_THEIR_KEY = ("dim_customers", "dim_products", "dim_date", "fct_orders")


def store_returned_items(items: DataFrame, returns: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``returned_items``, stored, and how many item ids repeat in ``items``: both need the items' keys by item id.

    ``first_row`` marks one row of each order and item.
    """
    joined = items.select(*intermediate.ITEM_KEYS).join(intermediate.returns_per_item(returns), "order_item_id", "left")
    same_id = Window.partitionBy("order_item_id").orderBy("order_item_id", "order_id")
    same_pair = Window.partitionBy("order_item_id", "order_id").orderBy("order_item_id", "order_id")
    again = (F.row_number().over(same_id) == 2) & F.col("order_item_id").isNotNull()
    marked = joined.withColumn("again", again).withColumn("first_row", F.row_number().over(same_pair) == 1)
    stored = write_table(marked.where(F.col("n").isNotNull() | F.col("again")), path)
    return stored.where(F.col("n").isNotNull()).drop("again"), stored.where("again").count()


def publish_core(
    raw, root: str, as_of: dt.date, previous_orders: DataFrame | None = None, log: RuleLog | None = None
) -> dict[str, DataFrame]:
    """Write the order block and the core marts under ``root``; returns the stored tables.

    With ``previous_orders`` (an earlier stored fct_orders under another root) the orders are upserted
    into it by order id; columns that only one side has are kept. The rules of the core layer are counted while the
    marts are written and go to ``log``. Raises when a key that consumers count repeats: they
    count rows where that equals counting distinct orders, customers or products.
    """
    log = log or RuleLog()
    stg = {name: STAGING[name](getattr(raw, name)) for name in STAGING}
    customers, products = stg["raw_customers"], stg["raw_products"]
    orders, items = stg["raw_orders"], stg["raw_order_items"]
    payments, shipments, returns = stg["raw_payments"], stg["raw_shipments"], stg["raw_returns"]

    out = {}

    def store(mart: str, df: DataFrame, *cluster: str, known_unique: bool = False) -> None:
        unique = [r for r in rules_of(mart, "core") if r.kind == "unique" and mart not in BY_THEIR_KEY]
        now = [r for r in rules_of(mart, "core") if r not in unique]
        later = [] if known_unique else unique
        if known_unique:
            log.lines += [(r.layer, r.table, r.column, r.kind, 0) for r in unique]
        out[mart] = log.write(tag_personal(df, mart), now, f"{root}/{mart}", cluster)
        if later:
            log.add(check(out[mart], later))

    # Amounts, payments and shipments of an order are put together in one pass by order; the order block is a part of them.
    block = intermediate.int_orders_enriched(orders, items, products, returns)
    fact = enforce_contract(core.fct_orders(block, payments, shipments), "fct_orders")
    batch = None
    if previous_orders is not None:
        batch = write_table(fact, f"{root}/fct_orders_batch")
        fact = upsert(previous_orders, batch, "order_id")
    store("fct_orders", fact, "order_date", "customer_id")
    path = f"{root}/int_orders_enriched"
    if batch is None:  # the fact has the same layout
        enriched = write_as_stored(core.enriched_orders(out["fct_orders"]), path)
    else:
        enriched = write_clustered(core.enriched_orders(batch), path, "order_date", "customer_id")
    out["int_orders_enriched"] = enriched

    # An item id cannot repeat in the mart where it does not among all items and each of them has one order at most.
    found, again = store_returned_items(items, returns, fresh_path(raw.spark, "returned-items"))
    once = not again and "fct_orders.order_id" not in log.failures("unique")
    with settings(raw.spark, core.BY_ORDER):
        lines = enforce_contract(core.fct_order_items_by_order(items, orders, found.where("first_row and accepted")), "fct_order_items")
        store("fct_order_items", lines, "order_date", "product_id", known_unique=once)

    summary = intermediate.int_customer_order_summary(
        enriched, orders, items, products, returns, as_of, lines=out["fct_order_items"]
    )
    store("dim_customers", enforce_contract(core.dim_customers(customers, summary, as_of), "dim_customers"))
    performance = intermediate.int_product_performance(items, orders, returns, found)
    store("dim_products", enforce_contract(core.dim_products(products, performance), "dim_products"))
    store("dim_date", enforce_contract(core.dim_date(raw.spark), "dim_date"))

    store("fct_payments", enforce_contract(core.fct_payments(payments, orders), "fct_payments"), "payment_date", "order_id")
    counted = {f"{t}.{k}" for t, k in (("fct_orders", "order_id"), ("dim_customers", "customer_id"), ("dim_products", "product_id"))}
    repeated = {place: n for place, n in log.failures("unique").items() if place in counted}
    if repeated:
        raise RepeatedKeys(", ".join(f"{place}: {n}" for place, n in repeated.items()))
    return out


FEW_TOUCHED = 8  # touched orders are few up to one in so many
ORDER_FACTS = ("raw_orders", "raw_order_items", "raw_payments", "raw_shipments", "raw_returns")


def refresh_orders(raw, path: str, since: dt.datetime) -> DataFrame:
    """Bring ``fct_orders``, stored by month at ``path``, up to date with all rows loaded at ``since`` or later.

    Orders that a new row belongs to are computed again, and with them all orders of their customers, since a late order
    can change which one is the first. Rows that differ from the stored ones are merged; months without
    such rows keep their files.
    """
    spark, at = raw.spark, F.lit(since.isoformat(" ")).cast("timestamp_ntz")
    stg = {name: STAGING[name](getattr(raw, name)) for name in (*ORDER_FACTS, "raw_products")}
    fresh = reduce(DataFrame.unionByName, [stg[n].where(F.col("loaded_at") >= at).select("order_id") for n in ORDER_FACTS]).distinct()
    fresh = write_table(fresh, fresh_path(spark, "fresh-orders"))
    touched = stg["raw_orders"].join(fresh, "order_id", "left_semi")
    customers = touched.select("customer_id").distinct()
    without = touched.where(F.col("customer_id").isNull())
    orders = write_table(stg["raw_orders"].join(customers, "customer_id", "left_semi").unionByName(without), fresh_path(spark, "orders"))
    ids = orders.select("order_id")
    # The order fact keeps the rows of its orders only. Taking those of the touched orders before pays where they are few;
    # otherwise it would shuffle whole rows that shrink to their order first.
    few = orders.count() * FEW_TOUCHED <= stg["raw_orders"].count()
    touching = {n: stg[n].join(ids, "order_id", "left_semi") if few else stg[n] for n in ORDER_FACTS[1:]}
    items, payments, shipments, returns = touching.values()
    enriched = intermediate.int_orders_enriched(orders, items, stg["raw_products"], returns)
    fact = enforce_contract(core.fct_orders(enriched, payments, shipments), "fct_orders")
    stored = read_months(spark, path).join(ids, "order_id", "left_semi").select(*[F.col(c).alias(f"_was_{c}") for c in fact.columns])
    # The distinct rows that are not stored, as ``subtract`` has them; both sides lie by order already, and stay there though
    # all columns are compared. Stored rows have an order id here, so that a plain equality serves.
    same = [F.col(c).eqNullSafe(F.col(f"_was_{c}")) for c in fact.columns if c != "order_id"]
    changed = fact.join(stored, reduce(Column.__and__, same, F.col("order_id") == F.col("_was_order_id")), "left_anti").distinct()
    with settings(spark, core.BY_ORDER):
        batch = write_table(changed, fresh_path(spark, "changed-orders"))
    return upsert_months(spark, path, batch, "order_id", "order_date")


BUCKETED = ("orders", "order_items", "payments", "shipments")
LEAST_BUCKETS = 8


def publish_by_order(stg: dict[str, DataFrame], root: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The staged order facts in buckets of the order id: they join and group by order without a shuffle.

    A task reads a bucket of each fact. There are as many as the rows of the largest fact need by default, eight at least.
    """
    if buckets is None:
        most = max(stg[f"raw_{name}"].count() for name in BUCKETED)
        buckets = max(LEAST_BUCKETS, -(-most // limit(stg["raw_orders"], "bucketRows")))
    return {name: write_bucketed(stg[f"raw_{name}"], f"{root}/{name}", "order_id", buckets) for name in BUCKETED}


def order_status_report(facts: dict[str, DataFrame]) -> DataFrame:
    """Each order's amounts, payment and shipment state from facts that lie together by order.

    Merge joins are asked for: a broadcast would bring back an exchange.
    """
    totals = intermediate.order_totals(facts["orders"].hint("merge"), facts["order_items"])
    paid = intermediate.payment_rollup(facts["payments"]).select("order_id", "payment_status", "total_paid_eur", "is_refunded")
    columns = ["carrier", "shipment_status", "shipped_at", "delivered_at"]
    shipped = intermediate.primary_shipments(facts["shipments"], columns=columns).drop("shipped_at", "delivered_at")
    joined = totals.join(paid.hint("merge"), "order_id", "left").join(shipped.hint("merge"), "order_id", "left")
    return joined.select(
        "order_id", "customer_id", "order_date", "order_status", "item_count", "gross_revenue", "net_revenue", "payment_status",
        "total_paid_eur", "is_refunded", "carrier", "shipment_status", "days_to_deliver", "is_late_delivery",
    )


class RepeatedKeys(ValueError):
    pass


def consumer_marts(stored: dict[str, DataFrame], as_of: dt.date) -> dict[str, DataFrame]:
    """All finance, marketing and data-science tables over the stored core marts (lazy)."""
    orders, lines, payments = stored["fct_orders"], stored["fct_order_items"], stored["fct_payments"]
    customers, products = stored["dim_customers"], stored["dim_products"]
    features = data_science.customer_features(customers, orders, as_of)
    return {
        "fct_revenue": finance.fct_revenue(orders),
        "fct_refunds": finance.fct_refunds(payments, orders),
        "monthly_revenue_summary": finance.monthly_revenue_summary(orders),
        "product_margin_analysis": finance.product_margin_analysis(products, lines),
        "daily_flash_report": finance.daily_flash_report(orders, as_of),
        "country_revenue_breakdown": finance.country_revenue_breakdown(orders, as_of),
        "customer_segments": marketing.customer_segments(customers, as_of),
        "customer_ltv": marketing.customer_ltv(customers, orders, as_of),
        "cohort_analysis": marketing.cohort_analysis(customers, orders),
        "channel_attribution": marketing.channel_attribution(orders, customers, as_of),
        "fct_campaign_performance": marketing.fct_campaign_performance(orders, as_of),
        "customer_features": features,
        "order_sequence_features": data_science.order_sequence_features(orders),
        "product_affinity_features": data_science.product_affinity_features(lines, products),
        "churn_prediction_input": data_science.churn_prediction_input(features),
        "customer_lifetime_value_features": data_science.customer_lifetime_value_features(features, orders),
        "recommendation_input": data_science.recommendation_input(lines, products, as_of),
    }
