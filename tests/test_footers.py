"""Newest loads from footers."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import LOADED
from shopledger.sources import footers


def test_newest_load_reads_no_column(spark, raw, tmp_path):
    path, later = str(tmp_path / "orders"), LOADED + dt.timedelta(hours=5, microseconds=7)
    footers.write_with_load_number(raw("raw_orders", {"order_id": "1"}, {"order_id": "2"}), path)
    footers.write_with_load_number(raw("raw_orders", {"order_id": "3", "_loaded_at": later}), path)
    with footers.footer_reads(spark):
        plan = footers.newest_number(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(_loaded_micros)]" in plan and "order_id" not in plan
    assert footers.newest_load(spark, path) == later
    assert "PushedAggregation" not in spark.read.parquet(path).agg(F.max("_loaded_micros"))._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark, raw, tmp_path):
    path = str(tmp_path / "none")
    footers.write_with_load_number(raw("raw_orders", {"order_id": "1"}).where("false"), path)
    assert footers.newest_load(spark, path) is None
