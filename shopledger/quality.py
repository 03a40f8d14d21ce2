"""Data rules: declared column tests, freshness, contracts, personal data, key references.

Results are DataFrames of failures, not exceptions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.merge import repeated_keys
from .schemas import DOMAINS, PII_COLUMNS, contract
from .session import freed_shuffles


@dataclass(frozen=True)
class Rule:
    layer: str
    table: str
    column: str
    kind: str  # unique, not_null or accepted_values


# The declared column tests. layer, table | unique | not null | accepted values
DECLARED = """
seed raw_customers | customer_id | customer_id email |
seed raw_products | product_id | product_id |
seed raw_orders | order_id | order_id customer_id |
seed raw_order_items | order_item_id | order_item_id order_id product_id |
seed raw_payments | payment_id | payment_id order_id |
seed raw_shipments | shipment_id | shipment_id order_id |
seed raw_returns | return_id | return_id order_id |
seed raw_campaigns | campaign_id | campaign_id |
seed raw_campaign_attributions | attribution_id | attribution_id |
seed raw_web_events | event_id | event_id |
source raw_customers | customer_id | customer_id email | loyalty_tier acquisition_channel
source raw_products | product_id | product_id unit_price | category
source raw_orders | order_id | order_id customer_id | order_status
source raw_order_items | order_item_id | order_item_id order_id product_id |
source raw_payments | payment_id | payment_id order_id | payment_status
source raw_shipments | shipment_id | shipment_id order_id |
source raw_returns | return_id | return_id order_id |
source raw_campaigns | campaign_id | campaign_id |
source raw_campaign_attributions | attribution_id | attribution_id |
source raw_web_events | event_id | event_id |
staging stg_customers | customer_id email | customer_id first_name last_name email signup_date | gender loyalty_tier acquisition_channel
staging stg_products | product_id | product_id product_name unit_price | category material collection
staging stg_orders | order_id | order_id customer_id order_date | order_status
staging stg_order_items | order_item_id | order_item_id order_id product_id |
staging stg_payments | payment_id | payment_id order_id | payment_status
staging stg_shipments | shipment_id | shipment_id order_id | shipment_status
staging stg_returns | return_id | return_id order_id | refund_status
staging stg_campaigns | campaign_id | campaign_id |
staging stg_campaign_attributions | attribution_id | attribution_id |
staging stg_web_events | event_id | event_id session_id event_timestamp | event_type device_type
core dim_customers | customer_id | customer_id signup_date | gender loyalty_tier acquisition_channel customer_status
core dim_products | product_id | product_id product_name | category collection performance_tier
core dim_date | date_day | date_day |
core fct_orders | order_id | order_id customer_id order_date | order_status
core fct_order_items | order_item_id | order_item_id order_id product_id customer_id |
core fct_payments | payment_id | payment_id order_id | payment_status
finance fct_revenue | | date_day |
finance fct_refunds | payment_id | payment_id |
finance monthly_revenue_summary | year_month | year_month |
finance product_margin_analysis | | category |
finance daily_flash_report | date_day | date_day |
finance country_revenue_breakdown | country | country |
marketing customer_segments | customer_id | customer_id |
marketing customer_ltv | customer_id | customer_id |
marketing cohort_analysis | | signup_cohort_month order_cohort_month |
marketing channel_attribution | channel | channel |
features customer_features | customer_id | customer_id |
features product_affinity_features | product_id | product_id |
features order_sequence_features | order_id | customer_id order_id |
prep churn_prediction_input | customer_id | customer_id |
prep recommendation_input | | customer_id product_id |
prep customer_lifetime_value_features | customer_id | customer_id |
"""


def _declared() -> list[Rule]:
    rules = []
    for line in DECLARED.strip().splitlines():
        head, *fields = line.split("|")
        layer, table = head.split()
        for kind, columns in zip(("unique", "not_null", "accepted_values"), fields):
            rules += [Rule(layer, table, c, kind) for c in columns.split()]
    return rules


RULES = _declared()


def rules_of(table: str, layer: str | None = None, kinds: Iterable[str] | None = None) -> list[Rule]:
    return [
        r for r in RULES if r.table == table and layer in (None, r.layer) and (kinds is None or r.kind in kinds)
    ]


def check(df: DataFrame, rules: list[Rule], domains: Mapping[str, list] = DOMAINS) -> DataFrame:
    """Failures per rule: (layer, table_name, column_name, rule, failures).

    All not-null and accepted-values rules of the table share one pass, which the first unique rule shares as well: it
    groups by its column and counts the values that occur more than once, and failures of the others are added up on
    the way. Each further unique rule is a pass of its own. NULLs pass, as they do in accepted values.
    """
    tests = {
        "not_null": lambda c: F.col(c).isNull(),
        "accepted_values": lambda c: ~F.col(c).isin(*domains[c]),
    }
    rowwise = [r for r in rules if r.kind != "unique"]
    unique = [r for r in rules if r.kind == "unique"]
    failed = {r: f"_f{i}" for i, r in enumerate(rowwise)}
    counts = [F.count_if(tests[r.kind](r.column)).alias(f) for r, f in failed.items()]
    results = []
    if rowwise and unique:
        first, *unique = unique
        failed = {first: "_again"} | failed
        by_value = df.groupBy(F.col(first.column).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"), *counts)
        again = F.count_if((F.col("_rows") > 1) & F.col("_value").isNotNull()).alias("_again")
        once = by_value.agg(again, *[F.coalesce(F.sum(failed[r]), F.lit(0)).alias(failed[r]) for r in rowwise])
    elif rowwise:
        once = df.agg(*counts)
    if rowwise:
        results.append(once.select(F.inline(F.array(*[_line(r, F.col(f)) for r, f in failed.items()]))))
    for r in unique:
        results.append(
            repeated_keys(df, r.column).agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(_line(r, F.col("n")))))
        )
    return reduce(DataFrame.unionByName, results)


class RuleLog:
    """Failures of rules that are counted while tables are written."""

    def __init__(self):
        self.lines: list[tuple[str, str, str, str, int]] = []

    def write(self, df: DataFrame, rules: list[Rule], path: str, cluster: tuple = (), domains: Mapping[str, list] = DOMAINS) -> DataFrame:
        """Store ``df`` and count the failures of ``rules`` in the same pass; returns the stored table.

        A unique column marks the second row of each value, for which the rows of a value have to meet in a task:
        where the plan joins or groups by that column last, its shuffle serves. The counts are metrics of the write,
        taken after the last shuffle, so that the sampling for a range partitioning does not count twice.
        """
        marks = {r: f"_again{i}" for i, r in enumerate(rules) if r.kind == "unique"}
        marked = df
        for r, mark in marks.items():
            same = Window.partitionBy(r.column).orderBy(r.column)
            marked = marked.withColumn(mark, (F.row_number().over(same) == 2) & F.col(r.column).isNotNull())
        tests = {
            "unique": lambda r: F.col(marks[r]),
            "not_null": lambda r: F.col(r.column).isNull(),
            "accepted_values": lambda r: ~F.col(r.column).isin(*domains[r.column]),
        }
        placed = marked.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else marked
        seen = Observation()
        if rules:
            placed = placed.observe(seen, *[F.count_if(tests[r.kind](r)).alias(f"f{i}") for i, r in enumerate(rules)])
        with freed_shuffles(df.sparkSession):
            placed.drop(*marks.values()).write.mode("overwrite").parquet(path)
        if rules:
            found = seen.get
            self.lines += [(r.layer, r.table, r.column, r.kind, found[f"f{i}"]) for i, r in enumerate(rules)]
        return df.sparkSession.read.parquet(path)

    def add(self, checked: DataFrame) -> None:
        """Lines of ``check`` for rules that a write does not cover."""
        self.lines += [tuple(r) for r in checked.collect()]

    def failures(self, kind: str) -> dict[str, int]:
        return {f"{t}.{c}": n for _, t, c, k, n in self.lines if k == kind and n}

    def report(self, spark: SparkSession) -> DataFrame:
        """(layer, table_name, column_name, rule, failures), a line for each rule."""
        return spark.createDataFrame(self.lines, "layer string, table_name string, column_name string, rule string, failures bigint")


def _line(r: Rule, failures: Column) -> Column:
    return F.struct(
        F.lit(r.layer).alias("layer"),
        F.lit(r.table).alias("table_name"),
        F.lit(r.column).alias("column_name"),
        F.lit(r.kind).alias("rule"),
        failures.alias("failures"),
    )


def check_all(frames: Mapping[str, DataFrame], layer: str | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """``check`` over several tables by name."""
    picked = [(df, rules_of(table, layer, kinds)) for table, df in frames.items()]
    return reduce(DataFrame.unionByName, [check(df, rules) for df, rules in picked if rules])


# Hours since the last load.
WARN_AFTER_HOURS = 24
ERROR_AFTER_HOURS = 48


def freshness(
    frames: Mapping[str, DataFrame],
    now: dt.datetime,
    loaded_at: str = "_loaded_at",
    warn_after: int = WARN_AFTER_HOURS,
    error_after: int = ERROR_AFTER_HOURS,
) -> DataFrame:
    """Last load and state per source: pass, warn or error. A source without rows is an error."""
    at = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    results = []
    for table, df in frames.items():
        last = df.agg(F.max(loaded_at).alias("last_loaded_at"))
        hours = F.timestamp_diff("HOUR", F.col("last_loaded_at").cast("timestamp"), at.cast("timestamp"))
        # Compare exact times, not truncated hours.
        late = lambda limit: F.col("last_loaded_at") < at - F.make_dt_interval(hours=F.lit(limit))
        results.append(
            last.select(
                F.lit(table).alias("source_name"),
                "last_loaded_at",
                hours.alias("age_hours"),
                F.when(F.col("last_loaded_at").isNull() | late(error_after), "error")
                .when(late(warn_after), "warn")
                .otherwise("pass")
                .alias("state"),
            )
        )
    return reduce(DataFrame.unionByName, results)


def contract_problems(schema: T.StructType, expected: T.StructType) -> list[tuple[str, str]]:
    """(column, missing | extra | mistyped) between a schema and a contract."""
    have = {f.name: f.dataType for f in schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    problems = [(c, "missing") for c in want if c not in have]
    problems += [(c, "extra") for c in have if c not in want]
    problems += [(c, "mistyped") for c in want if c in have and have[c] != want[c]]
    return problems


class ContractError(ValueError):
    pass


def enforce_contract(df: DataFrame, mart: str) -> DataFrame:
    """``df`` in contract order; raises before any write when columns or types differ."""
    expected = contract(mart)
    problems = contract_problems(df.schema, expected)
    if problems:
        raise ContractError(f"{mart}: {problems}")
    return df.select(*expected.names)


def contract_report(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Per mart: number of missing, extra and mistyped columns, and its rows."""
    results = []
    for mart, df in marts.items():
        found = [kind for _, kind in contract_problems(df.schema, contract(mart))]
        results.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(mart).alias("mart"),
                *[F.lit(found.count(k)).cast("bigint").alias(k) for k in ("missing", "extra", "mistyped")],
                "row_count",
            )
        )
    return reduce(DataFrame.unionByName, results)


def tag_personal(df: DataFrame, table: str) -> DataFrame:
    """``df`` with ``pii`` in the metadata of its personal columns."""
    out = df
    for c in PII_COLUMNS.get(table, []):
        if c in df.columns:
            out = out.withMetadata(c, {"pii": True})
    return out


def redact(df: DataFrame, table: str) -> DataFrame:
    """Personal text as its SHA-256, other personal columns removed.

    Covers the declared columns of the table and any column tagged in its metadata.
    """
    tagged = {f.name for f in df.schema.fields if f.metadata.get("pii")}
    personal = tagged | set(PII_COLUMNS.get(table, []))
    out = []
    for f in df.schema.fields:
        if f.name not in personal:
            out.append(F.col(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.sha2(F.col(f.name), 256).alias(f.name))
    return df.select(*out)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent row and the number of rows that carry them (an extra check)."""
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return keys.join(parent.select(key).distinct(), key, "left_anti")
