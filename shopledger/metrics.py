"""Business metrics over the core marts.

Every metric is made of additive parts (sums and counts), so it is combined before each shuffle, and a
dimension of another entity is joined after the fact has shrunk to one row per foreign key and group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.dates import GRAINS
from .functions.money import quotient
from .operators.trailing import trailing_sum


@dataclass(frozen=True)
class Entity:
    """A mart with its key, default time column and foreign keys (key column -> mart)."""

    key: str
    time: str
    foreign: Mapping[str, str]


ENTITIES = {
    "dim_customers": Entity("customer_id", "signup_date", {}),
    "dim_products": Entity("product_id", "launched_at", {}),
    "fct_orders": Entity("order_id", "order_date", {"customer_id": "dim_customers"}),
}


@dataclass(frozen=True)
class Simple:
    """``agg`` of ``column`` over a mart, optionally only where a flag column is true; no value gives 0."""

    mart: str
    agg: str  # sum, average or count_distinct (of the mart's key)
    column: str
    only: str | None = None


@dataclass(frozen=True)
class Ratio:
    numerator: str
    denominator: str


@dataclass(frozen=True)
class Trailing:
    """Sum of another metric over the last ``days`` days; a coarser period shows its first day's value."""

    metric: str
    days: int


METRICS: dict[str, Simple | Ratio | Trailing] = {
    "total_customers": Simple("dim_customers", "count_distinct", "customer_id"),
    "avg_ltv": Simple("dim_customers", "average", "lifetime_value_eur"),
    "total_products": Simple("dim_products", "count_distinct", "product_id"),
    "avg_product_margin": Simple("dim_products", "average", "margin_pct"),
    "total_revenue": Simple("fct_orders", "sum", "net_revenue_eur"),
    "total_gross_revenue": Simple("fct_orders", "sum", "gross_revenue_eur"),
    "total_orders": Simple("fct_orders", "count_distinct", "order_id"),
    "average_order_value": Simple("fct_orders", "average", "net_revenue_eur"),
    "total_discount_amount": Simple("fct_orders", "sum", "discount_amount_eur"),
    "new_customer_orders": Simple("fct_orders", "count_distinct", "order_id", "is_first_order"),
    "returned_order_count": Simple("fct_orders", "count_distinct", "order_id", "has_returned"),
    "late_delivery_orders": Simple("fct_orders", "count_distinct", "order_id", "is_late_delivery"),
    "avg_days_to_ship": Simple("fct_orders", "average", "days_to_ship"),
    "discount_rate": Ratio("total_discount_amount", "total_gross_revenue"),
    "late_delivery_rate": Ratio("late_delivery_orders", "total_orders"),
    "revenue_last_7_days": Trailing("total_revenue", 7),
    "revenue_last_30_days": Trailing("total_revenue", 30),
}


def _mart_of(name: str) -> str:
    m = METRICS[name]
    if isinstance(m, Ratio):
        return _mart_of(m.numerator)
    if isinstance(m, Trailing):
        return _mart_of(m.metric)
    return m.mart


def _simple_parts(name: str) -> list[str]:
    m = METRICS[name]
    if isinstance(m, Ratio):
        return [m.numerator, m.denominator]
    return [name]


def _row_parts(name: str) -> dict[str, Column]:
    """Aggregates over fact rows, named so that they can be summed again."""
    m = METRICS[name]
    value = F.col(m.column)
    if m.only:
        value = F.when(F.col(m.only), value)
    if m.agg == "count_distinct":
        if m.column != ENTITIES[m.mart].key:
            raise ValueError(f"{name}: only the key of {m.mart} can be counted")
        return {f"_{name}_n": F.count(value)}
    parts = {f"_{name}_sum": F.sum(value)}
    if m.agg == "average":
        parts[f"_{name}_n"] = F.count(value)
    return parts


def _finish(name: str) -> Column:
    """Value of a simple metric from its summed parts; 0 for no value."""
    m = METRICS[name]
    if m.agg == "count_distinct":
        return F.coalesce(F.col(f"_{name}_n"), F.lit(0))
    if m.agg == "sum":
        return F.coalesce(F.col(f"_{name}_sum"), F.lit(0))
    return F.coalesce(quotient(F.col(f"_{name}_sum"), F.col(f"_{name}_n")), F.lit(0.0))


def _parts_by(
    names: Sequence[str],
    marts: Mapping[str, DataFrame],
    group_by: Sequence[str],
    grain: str | None,
    where: Column | str | None,
) -> DataFrame:
    mart = _mart_of(names[0])
    entity = ENTITIES[mart]
    rows = marts[mart] if where is None else marts[mart].where(where)
    own = [c for c in group_by if "__" not in c]
    foreign = [c for c in group_by if "__" in c]
    keys = [F.col(c) for c in own]
    if grain:
        keys.append(GRAINS[grain](F.col(entity.time)).alias("period"))
    by = [*own, *(["period"] if grain else [])]
    parts: dict[str, Column] = {}
    for name in names:
        parts |= _row_parts(name)

    owners = {}
    for c in foreign:
        prefix, column = c.split("__")
        owners.setdefault(f"{prefix}_id", []).append((c, column))
    out = rows.groupBy(*keys, *owners).agg(*[p.alias(n) for n, p in parts.items()])
    for key, columns in owners.items():
        other = marts[entity.foreign[key]].select(key, *[F.col(col).alias(c) for c, col in columns])
        out = out.join(other, key, "left")
    if owners:
        out = out.groupBy(*by, *foreign).agg(*[F.sum(n).alias(n) for n in parts])
    return out


def metric(
    name: str,
    marts: Mapping[str, DataFrame],
    group_by: Sequence[str] = (),
    grain: str | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """Metric by dimensions and period: the dimensions, ``period`` when a grain is given, the value.

    A dimension is a column of the metric's mart, or ``customer__country`` for a column of the mart that
    ``customer_id`` refers to. ``grain`` is day, week, month, quarter or year of the mart's time column.
    """
    m = METRICS[name]
    by = [*group_by, *(["period"] if grain else [])]
    if isinstance(m, Trailing):
        grain = grain or "day"
        daily = _parts_by([m.metric], marts, group_by, "day", where)
        daily = daily.where(F.col("period").isNotNull()).select(*group_by, "period", _finish(m.metric).alias("_v"))
        rolled = trailing_sum(daily, "period", "_v", m.days, list(group_by), name)
        if grain == "day":
            return rolled
        period = GRAINS[grain](F.col("period"))
        return (
            rolled.groupBy(*group_by, period.alias("_p"))
            .agg(F.min_by(name, "period").alias(name))
            .withColumnRenamed("_p", "period")
        )
    parts = _parts_by(_simple_parts(name), marts, group_by, grain, where)
    if isinstance(m, Ratio):
        return parts.select(*by, quotient(_finish(m.numerator), _finish(m.denominator)).alias(name))
    return parts.select(*by, _finish(name).alias(name))
