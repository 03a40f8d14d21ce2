"""Layouts: what a read of one value has to touch, and joins without a shuffle."""

import datetime as dt
import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from shopledger.catalogue import EXTRAS, models
from shopledger.plans import publish
from shopledger.sources import layout
from shopledger.sources.sinks import write_clustered

DDL = "id bigint, day date, customer string"


@pytest.fixture(scope="module")
def orders(spark):
    rng = random.Random(5)
    data = [(i, dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 255)), f"c{rng.randint(0, 999):03d}") for i in range(40_000)]
    return spark.createDataFrame(data + [(40_000, None, None)], DDL).repartition(4)


def groups_read(path, column, value):
    """Row groups whose bounds admit the value, and all of them."""
    hit = every = 0
    for file in glob.glob(os.path.join(path, "*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(i) for i in range(meta.num_columns)]
            stats = next(c.statistics for c in columns if c.path_in_schema == column)
            every += 1
            hit += stats is not None and stats.has_min_max and stats.min <= value <= stats.max
    return hit, every


def test_a_curve_prunes_by_both_columns(orders, tmp_path):
    curve, plain = str(tmp_path / "curve"), str(tmp_path / "plain")
    out = layout.write_along_curve(orders, curve, "day", "customer", files=64)
    assert rows(out) == rows(orders)
    by_day = groups_read(curve, "day", dt.date(2024, 5, 5))
    by_customer = groups_read(curve, "customer", "c500")
    write_clustered(orders.repartition(64), plain, "day", "customer")
    lexical = groups_read(plain, "customer", "c500")
    assert by_day[1] >= 50 and by_day[0] <= 16 and by_customer[0] <= 16
    assert lexical[0] / lexical[1] > 0.9 > 3 * by_customer[0] / by_customer[1]


def test_range_numbers(spark):
    frame = spark.createDataFrame([(i,) for i in [*range(100), None]], "v int")
    got = {r["v"]: r["n"] for r in frame.withColumn("n", layout.range_number(F.col("v"), [10, 20, 20 + 10, 55])).collect()}
    assert [got[v] for v in (None, 0, 9, 10, 19, 20, 30, 54, 55, 99)] == [0, 0, 0, 1, 1, 2, 3, 3, 4, 4]
    assert layout.range_cuts(frame.where("false"), "v") == []
    assert rows(layout.along_curve(frame.where("false"), "v")) == []


def test_buckets_join_and_group_without_an_exchange(spark, orders, tmp_path):
    one = layout.write_bucketed(orders, str(tmp_path / "one"), "id", 4)
    lines = orders.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    many = layout.write_bucketed(lines, str(tmp_path / "many"), "id", 4)
    joined = one.join(many.groupBy("id").agg(F.sum("n").alias("n")).hint("merge"), "id", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert joined.agg(F.sum("n")).first()[0] == 3 * 40_001 and joined.count() == 40_001


def test_the_report_over_buckets_has_no_exchange(spark):
    report = EXTRAS["a11_orders_in_buckets"](models(spark, SMALL))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3


def test_buckets_follow_the_rows(spark, tmp_path):
    m = models(spark, SMALL)
    staged = {f"raw_{n}": getattr(m, f"stg_{n}") for n in publish.BUCKETED}
    lines = m.stg_order_items.count()
    spark.conf.set("spark.shopledger.bucketRows", str(lines // 20))
    try:
        facts = publish.publish_by_order(staged, str(tmp_path / "many"))
    finally:
        spark.conf.unset("spark.shopledger.bucketRows")
    assert all(len(df.inputFiles()) >= 20 for df in facts.values())
    few = publish.publish_by_order(staged, str(tmp_path / "few"))
    assert all(len(df.inputFiles()) == 8 for df in few.values())
    assert rows(publish.order_status_report(facts)) == rows(publish.order_status_report(few))
