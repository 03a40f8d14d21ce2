"""Exact distinct counts that can be added up: bitmaps over dense key numbers.

Every key gets a number once, new keys going on from the last one. A state holds, for each day and combination of
dimensions, the set of its keys as bitmaps of 32,768 numbers each. Sets of a month, a year or fewer dimensions are unions of
stored ones, so no report reads the facts again, and a later batch is merged into the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import GRAINS
from ..session import fresh_path

INDEX_BITS = 33  # monotonically_increasing_id is (partition << 33) + index in partition


def key_numbers(keys: DataFrame, key: str, known: DataFrame | None = None, near: Sequence[str] = ()) -> DataFrame:
    """(key, number) for every key: those of ``known``, and for others the numbers after its last one; stored.

    Numbers have no gaps; NULL has none. New numbers follow the columns ``near``, of which a key has its smallest
    values, and else no order. Where these are the dimensions and the day of a state, a set's keys lie in a few
    bitmaps, and a state has about as many of them as sets; in no order, it has up to one for each key.
    """
    spark = keys.sparkSession
    held, place = keys.where(F.col(key).isNotNull()), [f"_near{i}" for i in range(len(near))]
    if near:
        smallest = F.min(F.struct(*[F.col(c).alias(p) for c, p in zip(near, place, strict=True)])).alias("_near")
        new = held.groupBy(key).agg(smallest).select(key, "_near.*")
    else:
        new = held.select(key).distinct()
    start = 0
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
        start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    path = fresh_path(spark, "keys")
    if near:
        new = new.repartitionByRange(*place, key).sortWithinPartitions(*place, key).select(key)
    new.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)  # stored, so that the ids stay
    stored = spark.read.parquet(path)
    part, index = F.shiftright("_id", INDEX_BITS), F.col("_id").bitwiseAND((1 << INDEX_BITS) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg((F.max(index) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = sizes.select("_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) + start).alias("_offset"))
    numbered = stored.join(offsets, part == F.col("_part")).select(key, (F.col("_offset") + index).alias("number"))
    all_keys = numbered if known is None else known.select(key, "number").unionByName(numbered)
    place = fresh_path(spark, "key-numbers")
    all_keys.write.parquet(place)
    return spark.read.parquet(place)


def distinct_state(rows: DataFrame, numbers: DataFrame, key: str, day: str, by: list[str]) -> DataFrame:
    """Sets of keys by day and dimensions: (*by, day, bucket, bits). A row without a key adds an empty set."""
    number = F.col("number")
    found = rows.select(key, F.col(day).alias("day"), *by).join(numbers, key, "left")
    placed = found.select(*by, "day", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    # Numbers travel, not bitmaps: combined before the shuffle, each task would hold a bitmap for nearly each of its rows.
    together = placed.repartition(*by, "day", "bucket")
    return together.groupBy(*by, "day", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merged_states(*states: DataFrame) -> DataFrame:
    """States of several batches as one."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*[c for c in rows.columns if c != "bits"]).agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, by: list[str], grain: str | None, name: str) -> DataFrame:
    """Distinct keys by dimensions (any of the state's) and, with a grain, ``period``."""
    keys = [*by]
    if grain:
        state, keys = state.withColumn("period", GRAINS[grain](F.col("day"))), [*by, "period"]
    sets = state.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
