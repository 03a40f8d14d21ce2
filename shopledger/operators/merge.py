"""Keyed upsert with schema growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-NULL keys that occur more than once, with their row counts."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, after checking that no key repeats; an upsert from such a source would be ambiguous."""
    if not repeated_keys(df, key).isEmpty():
        raise ValueError(f"merge source has repeated values of {key}")
    return df


def upsert(target: DataFrame, source: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Target with the source's columns set in rows of equal key, and new rows added.

    An update sets the columns that the source has and leaves the others as the target has them; columns that
    only the source has are appended (NULL for untouched rows), and columns that only the target has are NULL in new
    rows. ``source`` is read up to three times and should be a stored table. A small batch is broadcast by
    its size, so the target is then not shuffled. The result must go to another path than the one ``target`` reads.
    """
    if check:
        require_unique(source, key)
    ours, theirs = target.columns, source.columns
    marked = source.select(F.col(key).alias("__key"), F.struct(*theirs).alias("__new"))
    matched = target.join(marked, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    # A null field of a matching row is an update to NULL, hence the test on the key and no coalesce.
    updated = matched.select(
        *[F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in theirs and c != key else F.col(c) for c in ours],
        *[F.col(f"__new.{c}").alias(c) for c in theirs if c not in ours],
    )
    added = source.join(target.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    return updated.unionByName(added, allowMissingColumns=True)
