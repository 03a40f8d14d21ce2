"""Predicates, flags and banding."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NOT_KEPT


def kept(status: Column, excluded: Sequence[str] = NOT_KEPT) -> Column:
    """Status filter of the consumer marts; a NULL status is dropped."""
    return ~status.isin(*excluded)


def flag(condition: Column) -> Column:
    """Condition as a boolean that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default))


def band_up_to(c: Column, limits: Sequence[tuple[Any, Any]], default: Any) -> Column:
    """Bands with inclusive upper limits in ascending order."""
    return first_match([(c <= limit, value) for limit, value in limits], default)


def band_from(c: Column, limits: Sequence[tuple[Any, Any]], default: Any) -> Column:
    """Bands with inclusive lower limits in descending order."""
    return first_match([(c >= limit, value) for limit, value in limits], default)


def code_of(c: Column, codes: dict[Any, Any], default: Any) -> Column:
    """Value by exact match; anything else, NULL included, gets the default."""
    return first_match([(c == key, value) for key, value in codes.items()], default)
