"""Money and ratio expressions.

Money stays decimal through every sum. A mean is the double quotient of the exact decimal sum and
the count. A rounded ratio is rounded as ``decimal(28,8)``, so ties round half up and do not depend
on the binary form of the quotient.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def money(c: Column) -> Column:
    return c.cast(MONEY)


def rounded(c: Column, places: int) -> Column:
    """Half-up rounding of a double through decimal(28,8); the result is a double."""
    return F.round(c.cast("decimal(28,8)"), places).cast("double")


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles; NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, places: int = 2) -> Column:
    return rounded(quotient(a, b), places)


def percent(a: Column, b: Column, places: int = 2) -> Column:
    """100 * a / b, rounded; NULL where b is 0."""
    return rounded(quotient(a, b) * 100, places)


def growth(now: Column, before: Column, places: int = 2) -> Column:
    """Percentage change from ``before`` to ``now``; NULL where ``before`` is 0 or NULL."""
    return percent(now - before, before, places)


def mean(c: Column) -> Column:
    """Average as exact sum over count; NULL for no value."""
    return quotient(F.sum(c), F.count(c))


def line_revenue(quantity: Column, unit_price: Column, discount_pct: Column) -> Column:
    """quantity * price * (1 - pct/100), rounded to cents in decimal arithmetic."""
    kept_share = F.lit(1) - discount_pct * F.lit(Decimal("0.01"))
    return money(F.round(quantity * unit_price * kept_share, 2))


# Euro per unit of currency; any other currency counts 1.0.
EUR_RATES = {"EUR": "1.00", "GBP": "1.17", "USD": "0.92", "CHF": "1.03"}


def to_eur(amount: Column, currency: Column, rates: dict[str, str] | None = None) -> Column:
    code = F.upper(currency)
    rate = None
    for name, value in (rates or EUR_RATES).items():
        value = F.lit(Decimal(value))
        rate = F.when(code == name, value) if rate is None else rate.when(code == name, value)
    return money(F.round(amount * rate.otherwise(F.lit(Decimal("1.00"))), 2))


def whole_cents(c: Column) -> Column:
    """An amount with two decimals as a whole number of cents."""
    return (c * 100).cast("decimal(18,0)")


def sample_deviation(c: Column) -> Column:
    """Sample standard deviation of amounts from exact moments; NULL for fewer than two values.

    Count, sum and sum of squares of whole cents are wide decimals, which add up to the same in any order; only the last
    quotient and root are doubles. The sum of squares times the count must stay below 10^38.
    """
    cents = whole_cents(c)
    n, total, squares = F.count(c), F.sum(cents), F.sum(cents * cents)
    wide = "decimal(38,0)"
    spread = n.cast("decimal(19,0)") * squares - total.cast(wide) * total.cast(wide)
    return F.sqrt(spread.cast("double") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))) / 100


def mean_units(total: Column, n: Column, places: int = 8) -> Column:
    """total / n (a sum of amounts with two decimals and its count) in whole units of 10^-places, rounded half up.

    Whole-number arithmetic throughout, so the result can be summed and compared exactly; NULL for n = 0.
    """
    scale = F.lit(2 * 10 ** (places - 2)).cast("decimal(18,0)")
    twice = (total * 100).cast("decimal(38,0)") * scale + n
    return F.call_function("div", twice.cast("decimal(38,0)"), F.nullif(2 * n, F.lit(0)).cast("decimal(20,0)"))
