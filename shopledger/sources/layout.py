"""Table layouts that later reads gain from: a curve over several columns, and buckets for joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freed_shuffles
from .sinks import write_table

RANGES_BITS = 8  # each column is cut into 2^8 ranges
SAMPLE_ROWS = 20_000  # values of a column that its ranges are drawn from; they steer the layout only


def range_cuts(df: DataFrame, column: str, bits: int = RANGES_BITS) -> list:
    """Up to 2^bits - 1 values that cut the rows into ranges of about equal size, from a sample."""
    total = df.count()
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, total))
    picked = df.select(column).where(F.col(column).isNotNull()).sample(share, seed=11)
    values = sorted(r[0] for r in picked.limit(2 * SAMPLE_ROWS).collect())
    n = 1 << bits
    return sorted({values[i * len(values) // n] for i in range(1, n)}) if values else []


def range_number(value: Column, cuts: list) -> Column:
    """Number of cuts that are not above the value, found in two steps; NULL is before all ranges."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    firsts = F.array(*[F.lit(b[0]) for b in blocks])
    nested = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    block = F.size(F.filter(firsts, lambda c: c <= value))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda c: c <= value))
    return F.when(value.isNull() | (block == 0), 0).otherwise((block - 1) * width + inside)


def curve_key(df: DataFrame, *columns: str, bits: int = RANGES_BITS) -> Column:
    """Range numbers of the columns with their bits interleaved, highest first (a Z-order curve)."""
    numbers = [range_number(F.col(c), range_cuts(df, c, bits)).cast("bigint") for c in columns]
    key = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for n in numbers:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(n, bit).bitwiseAND(F.lit(1)))
    return key


def along_curve(df: DataFrame, *columns: str, files: int | None = None) -> DataFrame:
    """Rows laid out along a curve over ``columns``: neighbours in all of them lie together.

    A filter on any one of the columns then leaves about a square root (for two columns) of the files and row
    groups, where a lexicographic order serves the first column alone. Rows of equal key are ordered by the columns.
    """
    keyed = df.withColumn("_curve", curve_key(df, *columns))
    dealt = keyed.repartitionByRange(files, "_curve", *columns) if files else keyed.repartitionByRange("_curve", *columns)
    return dealt.sortWithinPartitions("_curve", *columns).drop("_curve")


def write_along_curve(df: DataFrame, path: str, *columns: str, files: int | None = None) -> DataFrame:
    return write_table(along_curve(df, *columns, files=files), path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` in ``buckets`` by a hash of ``key``, sorted by it; returns the stored table.

    Tables with equal key types and numbers of buckets are joined and grouped by the key without a shuffle. The table is
    known to the session's catalogue under a name of its own; the files lie at ``path``. Rows are dealt
    to their bucket before the write, so that a bucket is one sorted file.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)
    with freed_shuffles(spark):
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
