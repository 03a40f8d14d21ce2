"""A fact stored by month, and an upsert that rewrites only the months that a batch touches.

The table is a folder of ``month=yyyy-MM`` partitions (``month=none`` for rows without a day). A batch touches the
months of its own rows and those in which older versions of its keys lie; the latter are found by a scan of the key
column alone. Only these months are read, merged and replaced; the files of all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import require_unique, upsert
from ..session import fresh_path, freed_shuffles

MONTH = "month"
NO_MONTH = "none"


def month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_MONTH))


def _write(df: DataFrame, path: str, day: str, overwrite: bool) -> None:
    # One task for each month and a share of its rows: a month with very many rows is written by several tasks,
    # which the planner sees to, and a small one makes one file. Rows that replace others come from files by month.
    rows = df.withColumn(MONTH, month_of(F.col(day)))
    rows = rows if overwrite else rows.hint("rebalance", F.col(MONTH))
    writer = rows.sortWithinPartitions(MONTH, day).write.partitionBy(MONTH)
    if overwrite:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)


def read_months(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The stored fact without its partition column; columns that only later files have are NULL in earlier ones."""
    table = spark.read.option("mergeSchema", "true").schema(_schema(spark, path)).parquet(path)
    if months is not None:
        table = table.where(F.col(MONTH).isin(months))
    return table.drop(MONTH)


def _schema(spark: SparkSession, path: str):
    # Month names stay text, whatever the session infers from them.
    found = spark.read.option("mergeSchema", "true").parquet(path).schema
    found[MONTH].dataType = T.StringType()
    return found


def write_months(df: DataFrame, path: str, day: str) -> DataFrame:
    """Store ``df`` by the month of ``day``; returns the stored table."""
    _write(df, path, day, overwrite=False)
    return read_months(df.sparkSession, path)


def touched_months(spark: SparkSession, path: str, batch: DataFrame, key: str, day: str) -> list[str]:
    """Months of the batch's rows and of older rows with its keys. Reads one column of the table."""
    stored = spark.read.parquet(path).select(F.col(MONTH).cast("string").alias(MONTH), key)
    older = stored.join(batch.select(key), key, "left_semi").select(MONTH)
    new = batch.select(month_of(F.col(day)).alias(MONTH))
    return sorted(r[0] for r in older.union(new).distinct().collect())  # as many rows as there are months at most


def _drop_months(spark: SparkSession, path: str, months: list[str]) -> None:
    """Remove partitions that no row is left in."""
    jvm = spark._jvm
    for m in months:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH}={m}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert_months(spark: SparkSession, path: str, batch: DataFrame, key: str, day: str) -> DataFrame:
    """Merge ``batch`` (a stored table with unique ``key`` and the column ``day``) into the fact at ``path``.

    The semantics are those of ``upsert``: columns that the batch has are set in rows of equal key, others are kept,
    new rows and new columns are added. A row whose day moves to another month changes its partition. The merged
    months are written beside the table first; then partitions that were left empty go, and the others are
    replaced. A run that failed in between is repeated with the same batch: rows that had left a dropped
    partition are in the batch, with the columns that the batch has.
    """
    require_unique(batch, key)
    months = touched_months(spark, path, batch, key, day)
    if not months:
        return read_months(spark, path)
    aside = fresh_path(spark, "merged-months")
    merged = upsert(read_months(spark, path, months), batch, key, check=False)
    _write(merged, aside, day, overwrite=False)
    left = {r[0] for r in spark.read.schema(_schema(spark, aside)).parquet(aside).select(MONTH).distinct().collect()}
    _drop_months(spark, path, [m for m in months if m not in left])
    _write(read_months(spark, aside), path, day, overwrite=True)
    return read_months(spark, path)

