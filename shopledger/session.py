"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Run-time SQL settings the models are designed for; none of them changes a result.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Sizes above which the operators split work; ``spark.shopledger.<name>`` of the session overrides them.
# They steer plans only, never results.
LIMITS = {
    "heavyRows": 1_000_000,  # rows of one key that a task may hold
    "localRows": 1_000_000,  # rows that one task may order by itself
    "bucketRows": 1_000_000,  # rows of a fact in one of its buckets
    "wideGroup": 256,  # rows of a group that still emits item pairs
    "tileItems": 1024,  # items of a block of wide groups; a tile counts the pairs of two blocks
    "tileRows": 4_000_000,  # memberships in wide groups that a tile holds
}


def limit(df, name: str, given: int | None = None) -> int:
    """``given``, else the session's setting, else the default."""
    if given is not None:
        return given
    return int(df.sparkSession.conf.get(f"spark.shopledger.{name}", str(LIMITS[name])))


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is made only for a local master without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="shopledger-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared root that nothing has written to yet."""
    return f"{shared_root(spark)}/shopledger/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run-time settings that hold inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Each write inside removes its shuffle files when it ends.

    They would stay until the driver happens to collect garbage, so that those of many writes lie on the disks at once. For
    writes only, whose plan is run once: a frame that is run again would have to shuffle again.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
