"""Facts stored by month."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from shopledger.catalogue import EXTRAS, LoadedBefore, models
from shopledger.operators.merge import upsert
from shopledger.plans import data_science, publish
from shopledger.plans.models import RetailModels, StagedTables
from shopledger.plans.publish import refresh_orders
from shopledger.session import settings
from shopledger.sources.monthly import read_months, touched_months, upsert_months, write_months
from shopledger.sources.sinks import write_table
from shopledger.sources.tables import AS_OF

FACT = "id bigint, day date, state string, value int"


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture
def fact(spark, tmp_path):
    table = [(i, day(f"2024-0{i % 6 + 1}-1{i % 9}"), "old", i) for i in range(60)] + [(60, None, "old", 60)]
    path = str(tmp_path / "fact")
    frame = spark.createDataFrame(table, FACT)
    write_months(frame, path, "day")
    return path, frame


def files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def changed_months(before, after):
    return {d.rsplit("=", 1)[1] for d, _ in {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}}


def stored(spark, tmp_path, data, ddl):
    spark.createDataFrame(data, ddl).write.parquet(str(tmp_path / "batch"))
    return spark.read.parquet(str(tmp_path / "batch"))


def test_only_touched_months_are_rewritten(spark, tmp_path, fact):
    path, frame = fact
    before = files(path)
    batch = stored(spark, tmp_path, [(1, day("2024-02-11"), "new"), (100, day("2024-02-28"), "new"), (2, day("2024-05-01"), "new")], "id bigint, day date, state string")
    out = upsert_months(spark, path, batch, "id", "day")
    assert rows(out.select(frame.columns)) == rows(upsert(frame, batch, "id"))
    # 2 moved from March to May.
    assert changed_months(before, files(path)) == {"2024-02", "2024-03", "2024-05"}
    assert rows(read_months(spark, path, ["2024-01"])) == rows(frame.where("month(day) = 1"))


def test_new_columns_and_new_months(spark, tmp_path, fact):
    path, frame = fact
    before = files(path)
    batch = stored(spark, tmp_path, [(7, day("2024-02-17"), "x"), (200, day("2025-01-01"), "y"), (60, None, "z")], "id bigint, day date, note string")
    out = upsert_months(spark, path, batch, "id", "day")
    assert rows(out.select(*frame.columns, "note")) == rows(upsert(frame, batch, "id"))
    assert changed_months(before, files(path)) == {"2024-02", "2025-01", "none"}


def test_a_month_that_all_rows_leave(spark, tmp_path, fact):
    path, frame = fact
    moved = [(r["id"], day("2024-04-30"), "moved") for r in frame.where("month(day) = 3").collect()]
    batch = stored(spark, tmp_path, moved, "id bigint, day date, state string")
    out = upsert_months(spark, path, batch, "id", "day")
    assert out.where("month(day) = 3").isEmpty() and out.count() == 61
    again = upsert_months(spark, path, batch, "id", "day")  # a second run changes nothing
    assert again.count() == 61 and again.where("state = 'moved'").count() == len(moved)


def test_repeated_keys_and_empty_batches(spark, tmp_path, fact):
    path, frame = fact
    with pytest.raises(ValueError):
        upsert_months(spark, path, frame.union(frame), "id", "day")
    before = files(path)
    assert upsert_months(spark, path, frame.where("false"), "id", "day").count() == 61
    assert files(path) == before
    assert touched_months(spark, path, frame.where("id = 60"), "id", "day") == ["none"]


def test_keys_are_looked_up_in_one_column(spark, fact):
    path, frame = fact
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    seen = spark.read.parquet(path).select("id").join(frame.select("id"), "id", "left_semi")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    pruned = read_months(spark, path, ["2024-01"]).where(F.col("value") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in pruned


class OnePaymentLater:
    """The raw tables with a payment of one order changed by a later load."""

    def __init__(self, raw):
        self.spark, self._raw = raw.spark, raw

    def __getattr__(self, name):
        table, own = getattr(self._raw, name), F.col("order_id") == "7"
        if name != "raw_payments":
            return table
        late = F.lit("2002-01-01").cast("timestamp_ntz")
        status = F.when(own, "refunded").otherwise(F.col("payment_status"))
        return table.withColumn("payment_status", status).withColumn("_loaded_at", F.when(own, late).otherwise(F.col("_loaded_at")))


def test_a_refresh_leaves_months_without_changes_alone(spark, tmp_path):
    m, path = models(spark, SMALL), str(tmp_path / "orders")
    write_months(m.fct_orders, path, "order_date")
    before, changed = files(path), OnePaymentLater(m.raw)
    out = refresh_orders(changed, path, dt.datetime(2002, 1, 1))
    want = RetailModels(StagedTables(changed), AS_OF).fct_orders
    assert rows(out.select(want.columns)) == rows(want) != rows(m.fct_orders)
    after, month = files(path), m.fct_orders.where("order_id = '7'").first().order_date.strftime("%Y-%m")
    assert changed_months(before, after) == {month}
    refresh_orders(changed, path, dt.datetime(2002, 1, 1))  # nothing differs any more
    assert files(path) == after


def test_a_refresh_after_rows_of_many_months(spark, tmp_path):
    raw, path = models(spark, SMALL).raw, str(tmp_path / "orders")
    write_months(RetailModels(StagedTables(LoadedBefore(raw, "2000-06-20")), AS_OF).fct_orders, path, "order_date")
    want = models(spark, SMALL).fct_orders
    assert rows(refresh_orders(raw, path, dt.datetime(2000, 6, 20)).select(want.columns)) == rows(want)


def test_a_refresh_moves_the_new_rows_and_the_stored_ones_by_order_alone(spark, tmp_path, monkeypatch):
    """The changed rows are found without a second shuffle of whole rows by all their columns."""
    raw, path = models(spark, SMALL).raw, str(tmp_path / "orders")
    write_months(RetailModels(StagedTables(LoadedBefore(raw, "2000-06-20")), AS_OF).fct_orders, path, "order_date")
    plans = []

    def noted(df, place):
        if "changed-orders" in place:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write_table(df, place)

    monkeypatch.setattr(publish, "write_table", noted)
    refresh_orders(raw, path, dt.datetime(2000, 6, 20))
    (plan,) = plans
    (anti,) = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert re.search(r"\border_id#\d+ = _was_order_id#\d+", anti)


@pytest.mark.parametrize("share", [0, 10**9])
def test_a_refresh_of_few_and_of_many_orders(spark, tmp_path, monkeypatch, share):
    """The rows of touched orders are taken first, or all rows shrink to their order; whole rows lie by order once."""
    monkeypatch.setattr(publish, "FEW_TOUCHED", share)
    raw, path = models(spark, SMALL).raw, str(tmp_path / "orders")
    write_months(RetailModels(StagedTables(LoadedBefore(raw, "2000-06-20")), AS_OF).fct_orders, path, "order_date")
    plans = []

    def noted(df, place):
        if "changed-orders" in place:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write_table(df, place)

    monkeypatch.setattr(publish, "write_table", noted)
    want = models(spark, SMALL).fct_orders
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert rows(refresh_orders(raw, path, dt.datetime(2000, 6, 20)).select(want.columns)) == rows(want)
    (plan,) = plans
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("_was_" in line or "is_refunded" in line for line in exchanges)


def test_a_batch_of_a_sequence_reads_stored_orders(spark, monkeypatch):
    """The orders are put together once, not for each batch."""
    plans = []
    start, append = data_science.start_sequences, data_science.append_sequences
    monkeypatch.setattr(data_science, "start_sequences", lambda df, root: (plans.append(df), start(df, root)))
    monkeypatch.setattr(data_science, "append_sequences", lambda df, root, n: (plans.append(df), append(df, root, n)))
    EXTRAS["e05_sequence_continued"](models(spark, SMALL))
    assert len(plans) == 3
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in plans)
