"""Running number, previous values and distinct counts per key, safe for a very long sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path


def with_previous(
    df: DataFrame,
    key: str,
    day: str,
    tie: str,
    number: str,
    previous: dict[str, str],
    distinct: dict[str, str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Number the rows of each key by (day, tie) and add values of the row before.

    ``previous`` maps an output name to the column it lags, ``distinct`` an output name to the column
    whose distinct values are counted over the whole key.

    All rows are range-partitioned by (key, day, tie) into stored ``slices`` of similar size (the number of shuffle
    partitions by default), however they fall on keys and days. Each slice is numbered on its own. Only a
    slice's first and last key can go on in another slice; for these, a table with one row per key and slice
    brings the number and values over the cut. Slices follow the order, so the result equals the plain
    window. A NULL day is last.
    """
    distinct = distinct or {}
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in (key, day, tie)]
    # Stored, since the bounds of a range exchange are drawn anew wherever it is computed again.
    path = fresh_path(df.sparkSession, "slices")
    df.repartitionByRange(n, *order).withColumn("_cut", F.spark_partition_id()).write.parquet(path)
    sliced = df.sparkSession.read.parquet(path)
    inside = {name: f"_in_{name}" for name in [*previous, *distinct]}
    numbered = _windowed(
        sliced, [key, "_cut"], day, tie, "_local",
        {inside[n]: c for n, c in previous.items()}, {inside[n]: c for n, c in distinct.items()},
    )

    # Two keys per slice at most: whatever the data, these tables have a few rows for each slice.
    place = [e for i, c in enumerate((day, tie)) for e in (F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(f"_o{i}"))]
    ends = sliced.groupBy("_cut").agg(*_ends(key)).select(F.explode(F.array("_first", "_end")).alias("_k"))
    cut_keys = ends.groupBy("_k").agg(F.count(F.lit(1)).alias("_ends")).where("_ends > 1").select(F.col("_k.v").alias("_key"))
    over_cuts = sliced.join(F.broadcast(cut_keys), F.col(key).eqNullSafe(F.col("_key")))
    lagged = [F.col(c).alias(out) for out, c in previous.items()]
    pieces = over_cuts.groupBy("_key", "_cut").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct(*place, *lagged)).alias("_last"))
    by_slice = Window.partitionBy("_key").orderBy("_cut")
    carried = pieces.select(
        "_key",
        F.col("_cut").alias("_slice"),
        F.sum("_rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(by_slice).alias("_carry"),
    )
    out = numbered.join(
        F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cut") == F.col("_slice")), "left"
    ).drop("_key")

    for name, c in distinct.items():
        whole = over_cuts.groupBy("_key", c).agg(F.lit(1)).groupBy("_key").agg(F.count(c).alias("_whole"))
        out = (
            out.join(F.broadcast(whole), F.col(key).eqNullSafe(F.col("_key")), "left")
            .withColumn(inside[name], F.coalesce("_whole", inside[name]))
            .drop("_key", "_whole")
        )

    first_here = F.col("_local") == 1
    return out.select(
        *df.columns,
        (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(number),
        *[F.when(first_here, F.col(f"_carry.{n}")).otherwise(F.col(inside[n])).alias(n) for n in previous],
        *[F.col(inside[n]).alias(n) for n in distinct],
    )


def _ends(key: str) -> list:
    """First and last key of a slice, NULL as the last of all."""
    placed = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("v"))
    return [F.min(placed).alias("_first"), F.max(placed).alias("_end")]


def _windowed(df, keys, day, tie, number, previous, distinct) -> DataFrame:
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(F.col(day).asc_nulls_last(), F.col(tie).asc_nulls_last())
    return df.select(
        "*",
        F.row_number().over(ordered).cast("bigint").alias(number),
        *[F.lag(c).over(ordered).alias(out) for out, c in previous.items()],
        *[F.size(F.collect_set(c).over(group)).cast("bigint").alias(out) for out, c in distinct.items()],
    )


def sequence_ends(numbered: DataFrame, key: str, day: str, tie: str, number: str, previous: dict[str, str], distinct: dict[str, str]) -> DataFrame:
    """One row per key: how its sequence ends, for a later batch to go on from.

    The last number, day and tie, the values that the next row lags, and the sets of distinct values. Combined
    before the shuffle; a key has as many set members as the column has values.
    """
    place = [F.col(number), F.col(day).alias("day"), F.col(tie).alias("tie"), *[F.col(c).alias(f"last_{out}") for out, c in previous.items()]]
    return numbered.groupBy(key).agg(
        F.max(F.struct(*place)).alias("end"), *[F.collect_set(c).alias(f"set_{out}") for out, c in distinct.items()]
    )


def continued(
    ends: DataFrame, batch: DataFrame, key: str, day: str, tie: str, number: str, previous: dict[str, str], distinct: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """(the batch's rows numbered on from ``ends``, the new ends); the history is not read.

    The arguments are those of ``with_previous``, except that ``distinct`` goes into the ends alone: counts over a
    whole key change with every batch, so a reader joins them (``distinct_sizes``). Rows of a batch must come after
    the rows of their key that are there already, by (day, tie), a NULL day last; else ``ValueError``. ``ends`` and
    ``batch`` should be stored tables.
    """
    here = with_previous(batch, key, day, tie, "_n", {f"_p_{n}": c for n, c in previous.items()})
    met = here.join(ends.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    # Stored, since the check, the rows and the new ends read it.
    place = fresh_path(batch.sparkSession, "met")
    met.write.parquet(place)
    met = batch.sparkSession.read.parquet(place)
    end_day, end_tie = F.col("end.day"), F.col("end.tie")
    early = F.when(end_day.isNull(), F.col(day).isNotNull() | (F.col(tie) <= end_tie)).otherwise(
        F.col(day).isNotNull() & ((F.col(day) < end_day) | ((F.col(day) == end_day) & (F.col(tie) <= end_tie)))
    )
    if not met.where(F.col("end").isNotNull() & early).isEmpty():
        raise ValueError("a batch must come after the rows that are numbered already")
    first_here = F.col("_n") == 1
    rows = met.select(
        *batch.columns,
        (F.col("_n") + F.coalesce(F.col(f"end.{number}"), F.lit(0))).alias(number),
        *[F.when(first_here, F.col(f"end.last_{n}")).otherwise(F.col(f"_p_{n}")).alias(n) for n in previous],
    )
    new = sequence_ends(rows, key, day, tie, number, previous, distinct)
    both = ends.unionByName(new).groupBy(key).agg(
        F.max("end").alias("end"), *[F.array_distinct(F.flatten(F.collect_list(f"set_{out}"))).alias(f"set_{out}") for out in distinct]
    )
    return rows, both


def distinct_sizes(ends: DataFrame, key: str, distinct: dict[str, str]) -> DataFrame:
    """Distinct values per key, from the sets of the ends."""
    return ends.select(key, *[F.size(f"set_{out}").cast("bigint").alias(out) for out in distinct])
