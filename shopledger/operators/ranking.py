"""Top-1 per key, global positions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, limit


def most_frequent(counts: DataFrame, key: str, value: str, n: str, name: str) -> DataFrame:
    """Value with the highest count per key, ties to the smallest value.

    ``counts`` has one row per (key, value). A min over (-count, value) needs no sort of a whole group
    and is combined before the shuffle. NULL values come last among ties.
    """
    best = F.struct((-F.col(n)).alias("n"), F.col(value).isNull().alias("missing"), F.col(value).alias("v"))
    return counts.groupBy(key).agg(F.min(best).alias("_best")).select(key, F.col("_best.v").alias(name))


def earliest(df: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """First row per key by ``order`` ascending, NULLs last; combined before the shuffle.

    ``order`` must end in a unique column, so that the row is fully determined.
    """
    parts = []
    for i, c in enumerate(order):
        parts += [F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_o{i}")]
    carried = [c for c in payload if c not in order]
    first = F.struct(*parts, *[F.col(c) for c in carried])
    held = {c: f"_o{i}" for i, c in enumerate(order)} | {c: c for c in carried}
    return df.groupBy(key).agg(F.min(first).alias("_first")).select(
        key, *[F.col(f"_first.{held[c]}").alias(c) for c in payload]
    )


def global_positions(df: DataFrame, order: list[Column], name: str, local_rows: int | None = None) -> DataFrame:
    """``df`` with the 1-based position of every row in the total order ``order``.

    Up to ``localRows`` rows (counted first) are numbered by one window. Beyond that the rows are
    range-partitioned and sorted, so every task holds one slice; the slices are stored, their sizes
    give each slice its offset, and a row's position is offset plus index. ``order`` must be unique,
    which also lets a run of equal leading values be cut between slices.
    """
    if df.count() <= limit(df, "localRows", local_rows):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    index_bits = 33  # monotonically_increasing_id is (partition << 33) + index in partition
    path = fresh_path(df.sparkSession, "positions")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    slices = df.sparkSession.read.parquet(path)
    slice_no, index = F.shiftright("_id", index_bits), F.col("_id").bitwiseAND((1 << index_bits) - 1)
    sizes = slices.groupBy(slice_no.alias("_slice")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice: as many rows as shuffle partitions.
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        slices.withColumn("_slice", slice_no)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + index + 1)
        .drop("_id", "_slice", "_offset")
    )


def random_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in random order: every task keeps its best ``n``, only those are merged."""
    return df.orderBy(F.rand(seed)).limit(n)
