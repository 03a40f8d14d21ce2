"""Stored marts, and consumer marts over them, against the inline models."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, m, rows
from shopledger.catalogue import comparable, models
from shopledger.plans import core, intermediate
from shopledger.plans.publish import RepeatedKeys, consumer_marts, publish_core, store_returned_items
from shopledger.plans.staging import stg_order_items, stg_orders, stg_products, stg_returns
from shopledger.quality import RuleLog
from shopledger.schemas import CONTRACT_DDL, contract
from shopledger.session import settings
from shopledger.sources.sinks import clustered, write_as_stored, write_clustered, write_table
from shopledger.sources.tables import AS_OF


@pytest.fixture(scope="module")
def inline(spark):
    return models(spark, SMALL)


@pytest.fixture(scope="module")
def stored(spark, inline, tmp_path_factory):
    return publish_core(inline.raw, str(tmp_path_factory.mktemp("marts")), AS_OF)


def test_stored_marts_meet_their_contracts(stored):
    for mart in CONTRACT_DDL:
        have = {f.name: f.dataType for f in stored[mart].schema}
        assert have == {f.name: f.dataType for f in contract(mart)}, mart
        assert stored[mart].columns == contract(mart).names
    assert stored["dim_customers"].schema["email"].metadata == {"pii": True}


@pytest.mark.parametrize("mart", ["dim_customers", "dim_products", "fct_orders", "fct_order_items", "fct_payments"])
def test_stored_equals_inline(stored, inline, mart):
    assert rows(stored[mart]) == rows(getattr(inline, mart))


def test_order_block_out_of_the_order_fact(stored, inline):
    block = core.enriched_orders(stored["fct_orders"])
    assert [(f.name, f.dataType) for f in block.schema] == [(f.name, f.dataType) for f in inline.int_orders_enriched.schema]
    assert rows(block) == rows(stored["int_orders_enriched"]) == rows(inline.int_orders_enriched)


def test_consumers_over_stored_marts_equal_inline(stored, inline):
    for name, df in consumer_marts(stored, AS_OF).items():
        assert rows(comparable(df)) == rows(comparable(getattr(inline, name))), name


def test_second_run_upserts_orders(stored, inline, spark, tmp_path):
    number = F.col("order_id").cast("bigint")
    older = stored["fct_orders"].where(number % 2 == 0).withColumn("order_status", F.lit("old"))
    older = older.withColumn("legacy", F.lit("kept"))
    again = publish_core(inline.raw, str(tmp_path / "second"), AS_OF, previous_orders=older)["fct_orders"]
    assert again.columns[-1] == "legacy"  # no column is dropped
    assert rows(again.drop("legacy")) == rows(stored["fct_orders"])
    assert again.where((number % 2 == 0) & (F.col("legacy") != "kept")).isEmpty()
    assert again.where((number % 2 == 0) & F.col("legacy").isNull()).isEmpty()
    assert again.where((number % 2 == 1) & F.col("legacy").isNotNull()).isEmpty()


def test_repeated_order_ids_stop_the_publication(inline, tmp_path):
    class Twice:
        def __getattr__(self, name):
            table = getattr(inline.raw, name)
            return table.union(table.where("order_id = '1'")) if name == "raw_orders" else table

    with pytest.raises(RepeatedKeys, match="fct_orders.order_id: 1"):
        publish_core(Twice(), str(tmp_path / "twice"), AS_OF)


def test_building_a_model_reads_no_fact(spark, inline):
    """Jobs that run while plans are built read dimensions at most."""
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, "plans")
    try:
        fresh = models(spark, SMALL)
        for name in ("fct_order_items", "fct_payments", "fct_refunds", "product_margin_analysis", "recommendation_input"):
            getattr(fresh, name)
        assert len(tracker.getJobIdsForGroup(group)) <= 4  # category labels
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_invariants(stored):
    consumers = consumer_marts(stored, AS_OF)
    kept = stored["fct_orders"].where("order_status not in ('cancelled', 'pending')")
    total = kept.agg(F.sum("net_revenue_eur")).first()[0]
    assert consumers["fct_revenue"].agg(F.sum("net_revenue_eur")).first()[0] == total
    assert consumers["monthly_revenue_summary"].agg(F.sum("revenue_eur")).first()[0] == total
    # the last month-to-date value of a month is the month's total
    month = F.trunc("date_day", "MM")
    ends = consumers["fct_revenue"].groupBy("channel", "country", month.alias("m")).agg(
        F.max_by("cumulative_mtd_revenue", "date_day").alias("last"), F.sum("net_revenue_eur").alias("sum")
    )
    assert ends.where("last <> sum").count() == 0
    # linear credit adds up to the delivered revenue over order and acquisition channels
    delivered = stored["fct_orders"].where("order_status = 'delivered'").agg(F.sum("net_revenue_eur")).first()[0]
    last_touch = consumers["channel_attribution"].agg(F.sum("last_touch_revenue_eur")).first()[0]
    assert last_touch == delivered


def test_filters_and_columns_reach_the_stored_files(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = consumer_marts(stored, AS_OF)["country_revenue_breakdown"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date" in plan and "LessThanOrEqual(order_date" in plan
    scan = plan.split("ReadSchema:")[1]
    assert "net_revenue_eur" in scan and "gross_revenue_eur" not in scan and "carrier" not in scan
    report = consumer_marts(stored, AS_OF)["daily_flash_report"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date" in report


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    was, numbers = spark.conf.get(name), spark.range(20_000)
    stored = write_clustered(numbers.groupBy((F.col("id") % 977).alias("k")).count(), str(tmp_path / "counts"), "k")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # they are removed beside the next work
        time.sleep(0.2)
    assert not left
    assert stored.agg(F.sum("count")).first()[0] == 20_000
    assert spark.conf.get(name) == was


def test_a_view_of_a_stored_table_keeps_its_layout(spark, tmp_path):
    days = spark.range(40_000).select((F.hash("id") % 5000).alias("day"), "id")
    ranges = clustered(days, "day", "id")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        table = write_table(ranges, str(tmp_path / "table"))
    view = table.select("day", (F.col("id") + 1).alias("next"))
    assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
    out = write_as_stored(view, str(tmp_path / "view"))
    bounds = out.groupBy(F.input_file_name().alias("file")).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).orderBy("lo").collect()
    assert len(bounds) == len(table.inputFiles()) > 4
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:], strict=False))
    assert rows(out) == rows(view)


@pytest.fixture
def odd(raw):
    """Items and returns with absent and repeated ids, and returns whose order is not that of their item."""
    item = lambda i, o, p="p1", n=1: dict(order_item_id=i, order_id=o, product_id=p, quantity=m(n), unit_price_at_order=m("10"))
    back = lambda r, i, o, state: dict(return_id=r, order_item_id=i, order_id=o, refund_status=state, return_requested_at=dt.date(2024, 5, 9))
    orders = [dict(order_id=o, customer_id=c, order_date=dt.date(2024, 5, n), order_status=s) for n, (o, c, s) in enumerate(
        [("o1", "c1", "delivered"), ("o2", "c1", "returned"), ("o3", None, "delivered"), ("o4", "c2", "cancelled"), (None, "c2", "delivered")], 1
    )]
    items = [item("i1", "o1"), item("i2", "o1", "p2"), item("i2", "o2"), item("i2", "o2", "p2"), item("i3", "o3", "p3"), item(None, "o1", "p2"),
             item("i4", "o4"), item("i5", None), item("i6", "gone"), item("i7", "o2", None), item("", "o2")]
    returns = [back("r1", "i1", "o2", "approved"), back("r2", "i1", "o1", "rejected"), back("r3", "i2", "o1", "pending"), back("r4", "i3", "o3", "rejected"),
               back("r5", None, "o1", "approved"), back("r6", "i5", None, "approved"), back("r7", "i6", "gone", None), back("r8", "i4", "o4", None),
               back("r9", "", "o2", "approved")]
    products = [dict(product_id=p, category=c) for p, c in (("p1", "Bags"), ("p2", "Belts"), ("p3", None))]
    tables = {"raw_orders": orders, "raw_order_items": items, "raw_returns": returns, "raw_products": products}
    made = {name: raw(name, *found) for name, found in tables.items()}
    return stg_orders(made["raw_orders"]), stg_order_items(made["raw_order_items"]), stg_returns(made["raw_returns"]), stg_products(made["raw_products"])


def test_items_by_order_equal_those_by_item(spark, odd, tmp_path):
    """Keys that are absent, repeat or contradict each other; both ways of joining returns to their items."""
    orders, items, returns, products = odd
    found, repeated = store_returned_items(items, returns, str(tmp_path / "found"))
    assert repeated == 1  # i2
    want = core.fct_order_items(items, orders, returns)
    for conf in ({}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        with settings(spark, conf | core.BY_ORDER):
            lines = core.fct_order_items_by_order(items, orders, found.where("first_row and accepted"))
            assert rows(lines.select(want.columns)) == rows(want)
    assert want.where("has_been_returned").count() == 4
    performance = intermediate.int_product_performance(items, orders, returns)
    assert rows(intermediate.int_product_performance(items, orders, returns, found)) == rows(performance)
    assert performance.where("return_count > 0").count() == 3
    favorites = intermediate.favorite_categories(orders, items, products).where("customer_id is not null")
    assert rows(intermediate.favorite_categories_of_lines(want, products).where("customer_id is not null")) == rows(favorites) != []


def test_items_meet_orders_and_returns_in_one_shuffle(spark, odd, tmp_path):
    orders, items, returns, _ = odd
    found, _ = store_returned_items(items, returns, str(tmp_path / "found"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"} | core.BY_ORDER):
        lines = core.fct_order_items_by_order(items, orders, found.where("first_row and accepted"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(order_id") == plan.count("Exchange ") == 3


@pytest.mark.parametrize("orders, failures", [(("1", "1"), 1), (("1", "no such order"), 0)])
def test_repeated_item_ids_are_counted_in_the_mart(spark, inline, tmp_path, orders, failures):
    """An id that repeats among all items does so in the mart where both of its rows have an order."""

    class Again:
        def __getattr__(self, name):
            table = getattr(inline.raw, name)
            if name != "raw_order_items":
                return table
            one = table.where("order_id = '1'").orderBy("order_item_id").limit(1).withColumn("order_item_id", F.lit("twice"))
            return table.union(one.withColumn("order_id", F.lit(orders[0]))).union(one.withColumn("order_id", F.lit(orders[1])))

    log = RuleLog()
    publish_core(Again(), str(tmp_path / "again"), AS_OF, log=log)
    already = inline.fct_order_items.groupBy("order_item_id").count().where("count > 1").count()
    found = [n for _, t, c, k, n in log.lines if (t, c, k) == ("fct_order_items", "order_item_id", "unique")]
    assert found == [already + failures]


def test_no_items_and_no_returns(odd, tmp_path):
    orders, items, returns, _ = odd
    found, _ = store_returned_items(items.limit(0), returns.limit(0), str(tmp_path / "none"))
    assert found.count() == 0
