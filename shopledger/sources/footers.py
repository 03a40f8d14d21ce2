"""Answers from Parquet footers: the bounds that files keep of their columns, without reading a column.

Spark pushes ``min``, ``max`` and ``count`` of whole-number and date columns into a Parquet scan of the second data
source interface. Footers keep no usable bounds of timestamps, so a stored table carries its load time as a number too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD_NUMBER = "_loaded_micros"  # microseconds since 1970 of the load time
_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footer_reads(spark: SparkSession) -> Iterator[None]:
    """Aggregates over Parquet files that are read and run inside come from footers where they can."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def write_with_load_number(df: DataFrame, path: str, loaded_at: str = "_loaded_at") -> None:
    """Append ``df`` with its load time (without a zone, as sessions in UTC have it) as a number beside."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col(loaded_at).cast("timestamp_ntz"))
    df.withColumn(LOAD_NUMBER, micros).write.mode("append").parquet(path)


def newest_number(spark: SparkSession, path: str, column: str = LOAD_NUMBER) -> DataFrame:
    """One row ``newest``; to be run inside ``footer_reads``, where only footers are read for it."""
    return spark.read.parquet(path).agg(F.max(column).alias("newest"))


def newest(spark: SparkSession, path: str, column: str) -> int | dt.date | None:
    """The largest value of a whole-number or date column of a stored table, from its footers; None without one."""
    with footer_reads(spark):
        return newest_number(spark, path, column).first()["newest"]


def newest_load(spark: SparkSession, path: str) -> dt.datetime | None:
    """The latest load time of a stored table, from its footers; None without rows."""
    micros = newest(spark, path, LOAD_NUMBER)
    return None if micros is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)
