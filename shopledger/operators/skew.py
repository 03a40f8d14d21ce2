"""Joins and groups that stay balanced when one key holds a large share of the rows.

``heavy_keys`` finds such keys with a mergeable frequent-items sketch: one scan of the key column and
no shuffle of the rows. It only steers how work is split; no result depends on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import limit

# A key is heavy when it holds more than ``heavyRows`` rows, however many rows there are in all. The sketch
# tracks ten times 1 / HEAVY_SHARE keys and returns the 1 / HEAVY_SHARE most frequent ones at most.
HEAVY_SHARE = 0.001

# Tasks that merge the sketches of the scan tasks before the last merge, so that even several hundred
# thousand scan tasks leave a few hundred sketches for it.
SKETCH_MERGERS = 256


@dataclass(frozen=True)
class HeavyKeys:
    """Heavy values of a key column (None included) and the number of parts each is split into."""

    key_type: T.DataType
    parts: tuple[tuple[object, int], ...]

    def __bool__(self) -> bool:
        return bool(self.parts)

    def frame(self, df: DataFrame, name: str) -> DataFrame:
        """(name, parts): at most ``1 / share`` rows."""
        schema = T.StructType([T.StructField(name, self.key_type), T.StructField("parts", T.IntegerType())])
        return df.sparkSession.createDataFrame(list(self.parts), schema)


def heavy_keys(df: DataFrame, key: str, min_rows: int | None = None, share: float = HEAVY_SHARE) -> HeavyKeys:
    """Heavy values of ``df[key]``; runs one job whose result has at most ``1 / share`` rows.

    ``parts`` is the number of pieces that brings one piece of the key below the limits.
    """
    most = int(1 / share)
    tracked = 10 * most  # counts are off by at most 0.04 * share of all rows
    sketches = (
        df.select(key, (F.spark_partition_id() % SKETCH_MERGERS).alias("_merger"))
        .groupBy("_merger")
        .agg(F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch"))
    )
    # Grouped by a constant: without rows there is no sketch to combine.
    tally = sketches.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch")
    )
    most_rows = F.lit(max(1, limit(df, "heavyRows", min_rows))).cast("bigint")
    found = (
        tally.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("t"), most_rows.alias("limit"))
        .where(F.col("t.count") > F.col("limit"))
        .select(F.col("t.item"), F.ceil(F.col("t.count") / F.col("limit")).cast("int"))
    )
    return HeavyKeys(df.schema[key].dataType, tuple(tuple(r) for r in found.collect()))


def with_parts(df: DataFrame, heavy: HeavyKeys, key: str) -> DataFrame:
    """``df`` with ``parts`` of its key, 1 for every key that is not heavy."""
    if not heavy:
        return df.withColumn("parts", F.lit(1))
    h = F.broadcast(heavy.frame(df, "_heavy"))
    return (
        df.join(h, F.col(key).eqNullSafe(F.col("_heavy")), "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .drop("_heavy")
    )


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    min_rows: int | None = None,
    share: float = HEAVY_SHARE,
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) with heavy keys split on both sides.

    Rows of a heavy key are dealt over its parts by a hash of ``spread_by`` (a near-unique column), and
    its single lookup row is repeated once per part: at most ``2 / share`` added rows in total. Other
    keys travel unchanged, and without heavy keys this is the plain join. Heavy NULL keys are dealt out
    as well, though they match nothing. ``heavy`` passes heavy keys that are known already.
    """
    if heavy is None:
        heavy = heavy_keys(rows, key, min_rows, share)
    if not heavy:
        return rows.join(lookup, key, how)
    dealt = with_parts(rows, heavy, key).withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), F.col("parts").cast("bigint")).cast("int")
    )
    repeated = with_parts(lookup, heavy, key).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    return dealt.drop("parts").join(repeated.drop("parts"), [key, "_part"], how).drop("_part")

