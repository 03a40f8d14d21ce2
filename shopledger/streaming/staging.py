"""Arriving raw files as staged streams.

The staging models are row-wise and stateless, so the batch functions apply unchanged; there is no
watermark and no state to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.staging import STAGING
from ..sources.raw import stream_csv


def staged_stream(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Staged rows of a raw table whose CSV files keep arriving under ``path``."""
    return STAGING[table](stream_csv(spark, table, path))


def append_stream(staged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to the table at ``path``, each file exactly once."""
    return (
        staged.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
