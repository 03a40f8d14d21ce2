"""Running and trailing sums over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(value: str, keys: list[str | Column], order: str) -> Column:
    """Sum from the first row of the group to the current one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(w)


def day_spine(days: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """Every day from the first to the last one of ``days``, for each combination of ``keys``."""
    bounds = days.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    span = bounds.select(F.explode(F.sequence("_lo", "_hi")).alias(day))
    if not keys:
        return span
    # The groups of a report times its calendar: the shape of the dense result itself.
    filled = days.select(*keys).distinct().withColumn("_lo", bounds.select("_lo").scalar())
    filled = filled.withColumn("_hi", bounds.select("_hi").scalar())
    return filled.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))


def trailing_sum(daily: DataFrame, day: str, value: str, window_days: int, keys: list[str], name: str) -> DataFrame:
    """Sum of the last ``window_days`` days, the current one included, for every calendar day.

    ``daily`` has one row per key and day; days without a row count as zero.
    """
    spine = day_spine(daily, day, keys).alias("s")
    d = daily.alias("d")
    match = F.col(f"s.{day}") == F.col(f"d.{day}")
    for k in keys:
        match = match & F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}"))
    dense = spine.join(d, match, "left").select(
        *[F.col(f"s.{k}") for k in keys],
        F.col(f"s.{day}"),
        F.coalesce(F.col(f"d.{value}"), F.lit(0)).alias(value),
    )
    ordinal = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-(window_days - 1), 0)
    return dense.select(*keys, day, F.sum(value).over(w).alias(name))
