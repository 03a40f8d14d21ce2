"""Registered queries by inventory id, over one folder of benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality
from .metrics import metric
from .operators.distinct import distinct_counts, distinct_state, key_numbers, merged_states
from .operators.merge import upsert
from .operators.ranking import random_rows
from .operators.selection import Order, tiles
from .operators.skew import spread_join
from .oracle.extras import EXTRA_FINALS
from .oracle.metrics import METRIC_FINALS
from .oracle.models import FINALS as MODEL_FINALS
from .oracle import statement
from .plans import core, data_science
from .plans.models import RetailModels, StagedTables, in_report_order
from .plans.publish import BUCKETED, consumer_marts, order_status_report, publish_by_order, publish_core, refresh_orders
from .plans.staging import STAGING, stg_order_items, stg_orders, stg_payments
from .schemas import RAW_DDL
from .session import fresh_path, tune
from .sources.footers import newest, newest_load, write_with_load_number
from .sources.layout import write_along_curve
from .sources.monthly import upsert_months, write_months
from .sources.raw import load_csv, write_csv
from .sources.sinks import append_rows, with_next_keys, write_clustered, write_table
from .sources.tables import AS_OF, RetailTables

Query = Callable[[SparkSession, str], DataFrame]

def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# Staged plans of the last session and folder. They hold no data; reusing them saves the analysis of the
# same projections for every query.
_plans: dict[tuple, StagedTables] = {}


def models(spark: SparkSession, folder: str) -> RetailModels:
    key = (spark, folder)
    if key not in _plans:
        _plans.clear()
        _plans[key] = StagedTables(RetailTables(tune(spark), folder))
    return RetailModels(_plans[key], AS_OF)


EXTRAS: dict[str, Callable[[RetailModels], DataFrame]] = {}


def extra(fn: Callable[[RetailModels], DataFrame]):
    EXTRAS[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ sources and sinks
@extra
def a01_typed_csv_load(m):
    """Orders written as CSV, loaded with the declared schema, staged."""
    spark = m.raw.spark
    path = fresh_path(spark, "orders-csv")
    write_csv(m.raw.raw_orders, path)
    return stg_orders(load_csv(spark, "raw_orders", path))


def _through_csv(table: str):
    """A raw table written as CSV files, loaded with its declared schema, staged."""

    def run(m: RetailModels) -> DataFrame:
        path = fresh_path(m.raw.spark, f"{table}-csv")
        write_csv(getattr(m.raw, table), path)
        return STAGING[table](load_csv(m.raw.spark, table, path))

    return run


for _table in RAW_DDL:
    EXTRAS[f"a01_csv_{_table.removeprefix('raw_')}"] = _through_csv(_table)


@extra
def a04_full_refresh(m):
    """Order items stored as a table and read back."""
    return write_table(m.fct_order_items, fresh_path(m.raw.spark, "fct_order_items"))


@extra
def a06_merge_orders(m):
    """Fresh orders merged into a stored older copy: some orders are missing there, the rest have old states.

    The batch lacks the revenue, which matched orders keep, and brings the channel.
    """
    number = F.col("order_id").cast("bigint")
    columns = ["order_id", "customer_id", "order_date", "order_status"]
    older = m.order_amounts.where(number % 3 != 0).select(*columns, "net_revenue_eur")
    older = older.withColumn("order_status", F.lit("processing"))
    return _merged(m, older, m.order_amounts.where(number % 3 != 1).select(*columns, "channel"))


@extra
def a06_merge_one_month(m):
    """A batch of one month merged into orders stored by month: other months keep their files.

    Some of its orders are not stored yet, every seventh moves to a later month; it lacks the revenue and brings the channel.
    """
    number, day = F.col("order_id").cast("bigint"), F.col("order_date")
    columns = ["order_id", "customer_id", "order_date", "order_status"]
    older = m.order_amounts.where(number % 3 != 0).select(*columns, "net_revenue_eur")
    path = fresh_path(m.raw.spark, "orders-by-month")
    write_months(older.withColumn("order_status", F.lit("processing")), path, "order_date")
    batch = m.order_amounts.where(F.trunc("order_date", "MM") == "1998-03-01").select(*columns, "channel")
    batch = batch.withColumn("order_date", F.when(number % 7 == 0, F.date_add(day, 40)).otherwise(day))
    stored = write_table(batch, fresh_path(m.raw.spark, "batch-of-a-month"))
    return upsert_months(m.raw.spark, path, stored, "order_id", "order_date")


class LoadedBefore:
    """Raw tables as they were before a load time."""

    def __init__(self, raw: RetailTables, until: str):
        self.spark, self._raw, self._until = raw.spark, raw, F.lit(until).cast("timestamp_ntz")

    def __getattr__(self, name: str) -> DataFrame:
        table = getattr(self._raw, name)
        return table.where(F.col("_loaded_at") < self._until) if name.startswith("raw_") and name != "raw_products" else table


@extra
def a06_refresh_orders(m):
    """The order fact of what was loaded before a day, stored by month, and brought up to date with the rest."""
    spark, day = m.raw.spark, "2000-10-01"
    path = fresh_path(spark, "refreshed-orders")
    write_months(RetailModels(StagedTables(LoadedBefore(m.raw, day)), AS_OF).fct_orders, path, "order_date")
    return refresh_orders(m.raw, path, dt.datetime.fromisoformat(day))


def _merged(m, older: DataFrame, newer: DataFrame) -> DataFrame:
    """Both sides stored, then merged from the stored tables."""
    target = write_table(older, fresh_path(m.raw.spark, "merge-target"))
    return upsert(target, write_table(newer, fresh_path(m.raw.spark, "merge-source")), "order_id")


@extra
def a07_merge_new_columns(m):
    """A merge whose source brings two columns that the stored target does not have and lacks one that it has."""
    number = F.col("order_id").cast("bigint")
    fact = m.order_amounts
    older = fact.where(number % 3 != 0).select("order_id", "net_revenue_eur", "order_date")
    return _merged(m, older, fact.where(number % 3 != 1).select("order_id", "net_revenue_eur", "channel", "item_count"))


@extra
def a08_clustered_table(m):
    """The order block laid out by date and customer, stored and read back."""
    path = fresh_path(m.raw.spark, "int_orders_enriched")
    return write_clustered(m.int_orders_enriched, path, "order_date", "customer_id")


@extra
def a08_along_curve(m):
    """The order block laid out along a curve over date and customer, stored and read back."""
    path = fresh_path(m.raw.spark, "int_orders_enriched-curve")
    return write_along_curve(m.int_orders_enriched, path, "order_date", "customer_id")


@extra
def a11_orders_in_buckets(m):
    """Order, item, payment and shipment facts stored in buckets, and joined without a shuffle."""
    staged = {f"raw_{n}": getattr(m, f"stg_{n}") for n in BUCKETED}
    return order_status_report(publish_by_order(staged, fresh_path(m.raw.spark, "buckets")))


LOADED = dt.datetime(2001, 8, 1, 6)


def _appended(m, table: str, key: str, template: str, default: int, **changed) -> DataFrame:
    """Every row of a raw table submitted again under new keys, and appended to the stored table."""
    raw = getattr(m.raw, table)
    path = fresh_path(m.raw.spark, table)
    stored = write_table(raw.withColumn("_loaded_at", F.col("_loaded_at").cast("timestamp")), path)
    batch = raw.drop("_loaded_at").withColumnRenamed(key, "was").withColumns(changed)
    batch = with_next_keys(batch, stored, key, ["was"], template, default).drop("was")
    grown = append_rows(batch.select(*[c for c in raw.columns if c != "_loaded_at"]), path, LOADED)
    return grown.withColumn("_loaded_at", F.col("_loaded_at").cast("timestamp_ntz"))


def _today(m) -> Column:
    return F.lit(str(m.as_of)).cast("date")


@extra
def a09_append_batch(m):
    """All orders of a day again, under keys that go on from the highest stored one."""
    return _marked(stg_orders(_appended(m, "raw_orders", "order_id", "ORD_%d", 10600, order_date=_today(m))))


@extra
def a09_append_items(m):
    return _marked(stg_order_items(_appended(m, "raw_order_items", "order_item_id", "ITEM_%06d", 900)))


@extra
def a09_append_payments(m):
    return _marked(stg_payments(_appended(m, "raw_payments", "payment_id", "PAY_%06d", 600, payment_date=_today(m))))


def _marked(staged: DataFrame) -> DataFrame:
    """``is_new`` in place of the load time: whether a row has that of the batch."""
    return staged.withColumn("is_new", F.col("loaded_at") == F.lit(str(LOADED)).cast("timestamp_ntz")).drop("loaded_at")


@extra
def a13_next_keys(m):
    """New keys continuing a stored number of 20 digits, numbered slice by slice."""
    was = m.stg_orders.select(F.col("order_id").alias("was"), "customer_id")
    stored = m.stg_orders.select(F.concat(F.lit("ORD_9"), F.lpad("order_id", 19, "0")).alias("order_id"))
    return with_next_keys(was, stored, "order_id", ["was"], "ORD_%06d", 10600, local_rows=0)


@extra
def a13_next_keys_from_footers(m):
    """New keys that go on from the last number of a stored table, which its file footers tell."""
    spark = m.raw.spark
    path, number = fresh_path(spark, "numbered-orders"), F.col("order_id").cast("bigint")
    m.stg_orders.select(F.concat(F.lit("ORD_"), "order_id").alias("order_id"), number.alias("_number")).write.parquet(path)
    was = m.stg_orders.select(F.col("order_id").alias("was"), "customer_id")
    return with_next_keys(was, spark.read.parquet(path), "order_id", ["was"], "ORD_%06d", last=newest(spark, path, "_number") or 10600)


# ------------------------------------------------------------------ joins, windows, ranks under skew
@extra
def c02_spread_left_join(m):
    """Orders to customers with every customer above a small share split over several tasks."""
    lookup = m.stg_customers.select("customer_id", "email", "loyalty_tier")
    rows = m.stg_orders.select("order_id", "customer_id", "order_status")
    return spread_join(rows, lookup, "customer_id", "order_id", "left", min_rows=2)


@extra
def c05_co_purchase_wide_baskets(m):
    """Product affinity with baskets above eight lines counted by item classes instead of pairs."""
    return data_science.product_affinity_features(m.order_lines, m.dim_products, wide=8, min_rows=10)


@extra
def e04_sequence_of_heavy_customers(m):
    """Order sequence cut into many slices, so that customers go on from one to the next."""
    return data_science.order_sequence_features(m.order_amounts, slices=37)


@extra
def e05_sequence_continued(m):
    """Order sequence of three batches of orders, each numbered on from the stored ends of the one before."""
    spark, root, day = m.raw.spark, fresh_path(m.raw.spark, "sequences"), F.col("order_date")
    columns = ["order_id", "customer_id", "order_date", "order_status", "channel", "net_revenue_eur"]
    orders = write_table(m.order_amounts.select(*columns), fresh_path(spark, "sequence-orders"))  # each batch reads its part
    data_science.start_sequences(orders.where(day < "1998-01-01"), root)
    data_science.append_sequences(orders.where((day >= "1998-01-01") & (day < "2000-06-15")), root, 1)
    data_science.append_sequences(orders.where(day >= "2000-06-15"), root, 2)
    return data_science.stored_sequence_features(spark, root, 2)


@extra
def e08_ntile_by_borders(m):
    """Price quartiles and sevenths of the parts; the borders are searched until ten rows are left around each."""
    spark, order = m.raw.spark, Order(("-unit_price", "product_id"))
    parts = m.stg_products.select("product_id", "unit_price")
    quartiles = tiles(parts, fresh_path(spark, "tiles"), order, 4, "quartile", few=10)
    return tiles(quartiles, fresh_path(spark, "tiles"), order, 7, "seventh", few=10)


@extra
def f03_random_sample(m):
    """100 random customers: how many, how many distinct, how many known, and whether another seed gives others."""
    customers = m.stg_customers.select("customer_id")
    sample = random_rows(customers, 100, seed=7)
    other = random_rows(customers, 100, seed=8).withColumn("again", F.lit(1))
    return (
        sample.join(customers.withColumn("known", F.lit(1)), "customer_id", "left")
        .join(other, "customer_id", "left")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("customer_id").alias("customers"),
            F.sum("known").alias("known"),
            (F.count("again") < F.count(F.lit(1))).alias("differs"),
        )
    )


# ------------------------------------------------------------------ distinct counts from stored sets
def _sets(m, rows: DataFrame, key: str, day: str, by: list[str]) -> DataFrame:
    """The stored state of ``rows``."""
    state = distinct_state(rows, key_numbers(rows, key, near=[*by, day]), key, day, by)
    return write_table(state, fresh_path(m.raw.spark, f"{key}-sets"))


def _by_grains(state: DataFrame, by: list[str], name: str, grains=("day", "month", "year")) -> DataFrame:
    """Counts of several grains, all from one state."""
    counts = [distinct_counts(state, by, g, name).withColumn("grain", F.lit(g)) for g in grains]
    return reduce(DataFrame.unionByName, counts)


@extra
def d03_j01_customers_by_grain(m):
    by = ["country", "loyalty_tier"]
    return _by_grains(_sets(m, m.dim_customers, "customer_id", "signup_date", by), by, "total_customers")


@extra
def d03_j03_products_by_grain(m):
    by = ["category", "performance_tier"]
    return _by_grains(_sets(m, m.dim_products, "product_id", "launched_at", by), by, "total_products")


@extra
def d03_j07_orders_by_grain(m):
    by = ["shipping_country"]
    return _by_grains(_sets(m, m.order_amounts, "order_id", "order_date", by), by, "total_orders")


@extra
def d03_active_customers(m):
    """Customers with orders by channel and altogether, from the state of older orders and that of a later batch."""
    spark, orders = m.raw.spark, m.stg_orders
    older, later = orders.where("order_date < date '1999-01-01'"), orders.where("order_date >= date '1999-01-01'")
    near = ["channel", "order_date"]
    numbers = key_numbers(older, "customer_id", near=near)
    state = write_table(distinct_state(older, numbers, "customer_id", "order_date", ["channel"]), fresh_path(spark, "older-sets"))
    numbers = key_numbers(later, "customer_id", numbers, near)
    state = merged_states(state, distinct_state(later, numbers, "customer_id", "order_date", ["channel"]))
    state = write_table(state, fresh_path(spark, "merged-sets"))
    grains = ("week", "month", "quarter", "year")
    both = _by_grains(state, ["channel"], "customers", grains)
    return both.unionByName(_by_grains(state, [], "customers", grains).withColumn("channel", F.lit("all")))


# ------------------------------------------------------------------ data rules
def _staged(m) -> dict[str, DataFrame]:
    tables = {r.table for r in quality.RULES if r.layer == "staging"}
    return {t: getattr(m, t) for t in sorted(tables)}


def _raw(m) -> dict[str, DataFrame]:
    tables = {r.table for r in quality.RULES if r.layer == "source"}
    return {t: getattr(m.raw, t) for t in sorted(tables)}


@extra
def i01_unique(m):
    return quality.check_all(_staged(m), "staging", ["unique"])


@extra
def i02_not_null(m):
    return quality.check_all(_staged(m), "staging", ["not_null"])


@extra
def i03_accepted_values(m):
    return quality.check_all(_staged(m), "staging", ["accepted_values"])


@extra
def i04_one_pass_core(m):
    """All rules of the customer and order marts."""
    return quality.check_all({"dim_customers": m.dim_customers, "fct_orders": m.fct_orders}, "core")


@extra
def i04_rules_while_writing(m):
    """All rules of the core layer, counted by the writes that publish its marts."""
    log = quality.RuleLog()
    publish_core(m.raw, fresh_path(m.raw.spark, "checked-marts"), AS_OF, log=log)
    return log.report(m.raw.spark)


def _layer(name: str):
    """All rules of a layer over its raw tables or inline marts."""

    def run(m: RetailModels) -> DataFrame:
        tables = sorted({r.table for r in quality.RULES if r.layer == name})
        owner = m.raw if name in ("seed", "source") else m
        return quality.check_all({t: getattr(owner, t) for t in tables}, name)

    return run


for _name in ("seed", "source", "core", "finance", "marketing", "features", "prep"):
    EXTRAS[f"i04_rules_{_name}"] = _layer(_name)


@extra
def i05_source_freshness(m):
    return quality.freshness(_raw(m), dt.datetime(2001, 8, 2, 12))


@extra
def i05_freshness_from_footers(m):
    """Freshness of the ten raw tables, stored and then looked at through the footers of their files alone."""
    spark, loads = m.raw.spark, {}
    for table, df in _raw(m).items():
        path = fresh_path(spark, f"{table}-loads")
        write_with_load_number(df, path)
        loads[table] = spark.createDataFrame([(newest_load(spark, path),)], "_loaded_at timestamp_ntz")
    return quality.freshness(loads, dt.datetime(2001, 8, 2, 12))


@extra
def i06_contract_report(m):
    """All six contracts, and one of a mart that lacks a column, has one too many and one of another type."""
    marts = ["dim_customers", "dim_products", "dim_date", "fct_orders", "fct_order_items", "fct_payments"]
    report = quality.contract_report({n: getattr(m, n) for n in marts})
    altered = m.fct_payments.drop("gateway").withColumn("added", F.lit(1)).withColumn("currency", F.lit(0))
    broken = quality.contract_report({"fct_payments": altered})
    return report.unionByName(broken.withColumn("mart", F.lit("altered fct_payments")))


@extra
def i07_redacted_customers(m):
    return quality.redact(quality.tag_personal(m.stg_customers, "stg_customers"), "stg_customers").drop("loaded_at")


@extra
def i08_unknown_products(m):
    """Product references of order items without a row in a catalogue of the dearer products (an extra check)."""
    return quality.orphans(m.stg_order_items, m.stg_products.where("unit_price >= 1000"), "product_id")


# ------------------------------------------------------------------ metrics
def _metric(name, pick, **options):
    """Query for a metric; ``pick`` chooses the frames, so that unused joins are not part of the plan."""

    def run(m: RetailModels) -> DataFrame:
        return metric(name, pick(m), **options)

    return run


def _customers(m):
    return {"dim_customers": m.dim_customers}


def _products(m):
    return {"dim_products": m.dim_products}


def _amounts(m):
    return {"fct_orders": m.order_amounts}


def _first(m):
    return {"fct_orders": m.order_amounts_first}


def _enriched(m):
    return {"fct_orders": core.order_fact(m.int_orders_enriched)}


def _full(m):
    return {"fct_orders": m.fct_orders, "dim_customers": m.stg_customers}


METRIC_QUERIES = {
    "j01_total_customers": _metric("total_customers", _customers, group_by=["country", "loyalty_tier"]),
    "j02_avg_ltv": _metric("avg_ltv", _customers, group_by=["acquisition_channel"], grain="quarter"),
    "j03_total_products": _metric("total_products", _products, group_by=["category", "performance_tier"]),
    "j04_avg_product_margin": _metric("avg_product_margin", _products, group_by=["category"], grain="month"),
    "j05_total_revenue": _metric("total_revenue", _amounts, group_by=["channel"], grain="month"),
    "j06_total_gross_revenue": _metric("total_gross_revenue", _amounts, grain="quarter"),
    "j07_total_orders": _metric("total_orders", _amounts, group_by=["shipping_country"], grain="year"),
    "j08_average_order_value": _metric("average_order_value", _amounts, group_by=["channel"], grain="month"),
    "j09_total_discount_amount": _metric("total_discount_amount", _amounts, grain="week"),
    "j10_new_customer_orders": _metric("new_customer_orders", _first, grain="month"),
    "j11_returned_order_count": _metric("returned_order_count", _enriched, group_by=["channel", "order_status"]),
    "j12_late_delivery_orders": _metric("late_delivery_orders", _full, group_by=["carrier"], grain="year"),
    "j13_avg_days_to_ship": _metric("avg_days_to_ship", _full, group_by=["shipping_method"]),
    "j14_discount_rate": _metric("discount_rate", _amounts, grain="month", where="order_status <> 'cancelled'"),
    "j15_late_delivery_rate": _metric(
        "late_delivery_rate", _full, group_by=["channel", "customer__loyalty_tier", "customer__country"]
    ),
    "j16_revenue_last_7_days": _metric("revenue_last_7_days", _amounts),
    "j17_revenue_last_30_days": _metric("revenue_last_30_days", _amounts, group_by=["channel"], grain="month"),
}


def _model(key: str) -> Callable[[RetailModels], DataFrame]:
    name = key.split("_", 1)[1]
    return lambda m: in_report_order(name, getattr(m, name))


# Stored core marts of the last session and folder, and the consumers over them.
_stored: dict[tuple, dict[str, DataFrame]] = {}


def _over_stored(key: str) -> Callable[[RetailModels], DataFrame]:
    """A consumer mart that reads the published core marts, which are written once for a session and folder."""
    name = key.split("_", 1)[1]

    def run(m: RetailModels) -> DataFrame:
        place = (m.raw.spark, m.raw.folder)
        if place not in _stored:
            _stored.clear()
            _stored[place] = consumer_marts(publish_core(m.raw, fresh_path(m.raw.spark, "marts"), AS_OF), AS_OF)
        return in_report_order(name, _stored[place][name])

    return run


CONSUMERS = [k for k in MODEL_FINALS if 22 <= int(k[1:3]) <= 38]


def stored_key(key: str) -> str:
    return f"a11_{key}"


def registered_queries() -> dict[str, Query]:
    built = {key: _model(key) for key in MODEL_FINALS} | EXTRAS | METRIC_QUERIES
    built |= {stored_key(key): _over_stored(key) for key in CONSUMERS}

    def over_folder(build) -> Query:
        return lambda spark, folder: comparable(build(models(spark, folder)))

    return {key: over_folder(build) for key, build in built.items()}


def registered_statements() -> dict[str, str]:
    finals = MODEL_FINALS | EXTRA_FINALS | METRIC_FINALS
    return {key: statement(final) for key, final in (finals | {stored_key(k): MODEL_FINALS[k] for k in CONSUMERS}).items()}
