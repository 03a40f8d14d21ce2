"""Writing tables: full refresh, clustered refresh, append, and key continuation."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_positions
from ..session import freed_shuffles, settings


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Full refresh; returns the stored table."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_as_stored(df: DataFrame, path: str) -> DataFrame:
    """Store ``df``, a row-wise view of one stored table, in the layout that the table has; nothing is shuffled.

    Every file is read by a task of its own (a very large one by several), so that no task mixes the ranges of two.
    """
    spark = df.sparkSession
    with settings(spark, {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")}):
        return write_table(df, path)


def clustered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows laid out by ``columns``, so that file and row-group statistics prune later reads."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_clustered(df: DataFrame, path: str, *columns: str) -> DataFrame:
    return write_table(clustered(df, *columns), path)


def append_rows(df: DataFrame, path: str, loaded_at: dt.datetime | None = None) -> DataFrame:
    """Append one batch to a stored table; returns the grown table.

    Every row of the batch is stamped with the load time ``_loaded_at``: the given one, else the time at which the
    query starts, one for the whole batch.
    """
    stamp = F.current_timestamp() if loaded_at is None else F.lit(loaded_at)
    df.withColumn("_loaded_at", stamp.cast("timestamp")).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def highest_number(table: DataFrame, key: str, default: int) -> DataFrame:
    """One row ``last_number``, decimal(38,0): the largest number in the digits of ``key``, or ``default``.

    A key without digits, or with more digits than a 38-digit integer, has no number.
    """
    number = F.regexp_replace(F.col(key), "[^0-9]", "").try_cast("decimal(38,0)")
    return table.agg(F.coalesce(F.max(number), F.lit(default).cast("decimal(38,0)")).alias("last_number"))


def numbered(template: str, number: Column) -> Column:
    """Text of a whole number by a printf pattern with one ``%d`` or ``%0<width>d``, for any number of digits."""
    before, width, after = re.fullmatch(r"(.*?)%(?:0(\d+))?d(.*)", template).groups()
    digits = number.cast("string")
    if width:
        digits = F.when(F.length(digits) < int(width), F.lpad(digits, int(width), "0")).otherwise(digits)
    return F.concat(F.lit(before), digits, F.lit(after))


def with_next_keys(
    batch: DataFrame,
    table: DataFrame,
    key: str,
    order_by: list[str],
    template: str,
    default: int = 0,
    local_rows: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """``batch`` with a new column ``key`` that continues the numbering of ``table[key]``, or goes on from ``last``.

    ``template`` is a printf pattern such as ``ORD_%d`` or ``ITEM_%06d``. Numbers follow ``order_by``,
    which must be unique in the batch. A table that stores the numbers of its keys has the last one in its file
    footers (``footers.newest``).
    """
    last = F.lit(last).cast("decimal(38,0)") if last is not None else highest_number(table, key, default).scalar()
    placed = global_positions(batch, [F.col(c).asc_nulls_last() for c in order_by], "_n", local_rows)
    return placed.withColumn(key, numbered(template, F.col("_n").cast("decimal(38,0)") + last)).drop("_n")
