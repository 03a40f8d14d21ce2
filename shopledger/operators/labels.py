"""Sorted list of the distinct labels of a group, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import code_of

# Labels that fit the bits of a non-negative bigint.
MASK_LABELS = 63


def known_labels(df: DataFrame, column: str, most: int = MASK_LABELS) -> list[str] | None:
    """Sorted distinct non-NULL labels, or None when there are more than ``most``."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= most else None


class LabelList:
    """Distinct labels per group, joined in ascending order; '' for a group without any label.

    With few labels each one is a bit: the group keeps a single number that is combined by bit-or in a
    hash aggregate, without sets and without sorting rows. Otherwise the distinct labels are collected.
    """

    def __init__(self, labels: list[str] | None, separator: str = ", "):
        self.labels = labels
        self.separator = separator

    def encode(self, label: Column) -> Column:
        """Column to carry per row."""
        if self.labels is None:
            return label
        return code_of(label, {name: 1 << i for i, name in enumerate(self.labels)}, 0).cast("bigint")

    def combine(self, code: Column) -> Column:
        """Aggregate of the carried column."""
        if self.labels is None:
            return F.collect_set(code)
        return F.coalesce(F.bit_or(code), F.lit(0).cast("bigint"))

    def text(self, combined: Column) -> Column:
        """List of a combined value; NULL stays NULL."""
        if self.labels is None:
            return F.array_join(F.array_sort(combined), self.separator)
        names = F.array(*[F.lit(n) for n in self.labels]) if self.labels else F.array().cast("array<string>")
        bit = lambda i: F.call_function("shiftright", combined, i).bitwiseAND(1) == 1
        chosen = F.filter(names, lambda name, i: bit(i))
        return F.when(combined.isNotNull(), F.array_join(chosen, self.separator))
