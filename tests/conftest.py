import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from shopledger.schemas import raw_schema  # noqa: E402
from shopledger.session import tune  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LOADED = dt.datetime(2024, 6, 1, 6, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield tune(session)
    session.stop()


def d(text):
    return dt.date.fromisoformat(text)


def m(text):
    return Decimal(text)


@pytest.fixture(scope="session")
def raw(spark):
    """Frame of a raw table from dicts; fields that are not given are NULL, the load time is fixed."""

    def build(table, *rows):
        schema = raw_schema(table)
        out = [tuple({"_loaded_at": LOADED, **r}.get(f.name) for f in schema.fields) for r in rows]
        return spark.createDataFrame(out, schema)

    return build


def rows(df, *columns):
    """Set-like list of tuples, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def by(df, key):
    return {r[key]: r for r in df.collect()}
