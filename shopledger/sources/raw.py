"""Loading of raw tables with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import raw_schema


# The same for files at rest and arriving files: a header, blank is NULL, and no value that does not fit its type.
CSV_OPTIONS = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false", "nullValue": "", "emptyValue": ""}


def load_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Raw table from CSV files with a header row; a value that does not fit its type fails the read."""
    return spark.read.schema(raw_schema(table)).options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files that ``load_csv`` reads back as they were, times to the microsecond."""
    fraction = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.options(header="true", timestampNTZFormat=fraction).csv(path)


def load_parquet(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(raw_schema(table)).parquet(path)


def stream_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Raw table as a stream of arriving CSV files; a value that does not fit its type fails the stream."""
    return spark.readStream.schema(raw_schema(table)).options(**CSV_OPTIONS).csv(path)
