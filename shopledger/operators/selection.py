"""The rows at given ranks of a total order, and tiles, without sorting the table.

A rank's row is searched between two rows whose exact ranks are known. A sample of the rows between them gives two
splitters that the wanted row very probably lies between; one pass counts the rows up to every splitter, which proves it
or corrects it. Each pass leaves a few hundredths of the rows between the two, whatever the size of the table, until
few enough are left to be numbered.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import limit
from ..sources.sinks import write_table

SAMPLE = 2000  # rows that are drawn for one rank


@dataclass(frozen=True)
class Order:
    """Columns of a total order; ``-`` before a name is descending, with NULLs last; ascending has NULLs first."""

    names: tuple[str, ...]

    def columns(self) -> list[str]:
        return [n.removeprefix("-") for n in self.names]

    def sort(self) -> list[Column]:
        return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_first() for n in self.names]

    def up_to(self, row: tuple, df: DataFrame, strictly: bool = False) -> Column:
        """Whether a row is not behind (with ``strictly``: is before) ``row``, values in the order of the names."""
        out = F.lit(not strictly)
        for name, value in reversed(list(zip(self.names, row, strict=True))):
            c = F.col(name.removeprefix("-"))
            there = F.lit(value).cast(df.schema[name.removeprefix("-")].dataType)
            if name.startswith("-"):
                before = c.isNotNull() if value is None else F.coalesce(c > there, F.lit(False))
            else:
                before = F.lit(False) if value is None else F.coalesce(c < there, c.isNull())
            out = before | (c.eqNullSafe(there) & out)
        return out


@dataclass
class _Search:
    """The wanted row is behind ``low`` (of rank ``low_rank``) and not behind ``high`` (of rank ``high_rank``)."""

    rank: int
    low_rank: int
    high_rank: int
    low: tuple | None = None
    high: tuple | None = None

    def size(self) -> int:
        return self.high_rank - self.low_rank

    def inside(self, order: Order, df: DataFrame) -> Column:
        after = F.lit(True) if self.low is None else ~order.up_to(self.low, df)
        return after if self.high is None else after & order.up_to(self.high, df)

    def splitters(self, sample: list[tuple]) -> list[tuple]:
        """Rows of the sorted sample on both sides of where the wanted row should be."""
        at = (self.rank - self.low_rank) * len(sample) / self.size()
        slack = 3 * len(sample) ** 0.5 / 2 + 1
        places = {min(len(sample) - 1, max(0, int(at - slack))), min(len(sample) - 1, max(0, int(at + slack)))}
        return [sample[p] for p in sorted(places)] if sample else []

    def learn(self, row: tuple, rank: int) -> None:
        """``rank`` rows are not behind ``row``."""
        if rank < self.rank:
            if rank >= self.low_rank:
                self.low, self.low_rank = row, rank
        elif rank <= self.high_rank:
            self.high, self.high_rank = row, rank


def rows_at_ranks(table: DataFrame, order: Order, ranks: list[int], total: int, few: int) -> dict[int, tuple]:
    """The order columns of the rows at 1-based ``ranks``; ``order`` must be unique, ``table`` a stored table.

    ``few`` rows or less around a rank are numbered by one task. A handful of rows a rank reaches the driver, and
    the sample of a search.
    """
    columns, found = order.columns(), {}
    keys = table.select(*columns)
    searches = [_Search(r, 0, total) for r in sorted(set(ranks)) if 0 < r <= total]

    def of_searches(chosen: list[_Search], keep: list[float] | None = None) -> DataFrame:
        """Rows that lie inside of each search; a row can be in several. ``keep`` draws a share of them."""
        inside = [s.inside(order, keys) for s in chosen]
        if keep:
            inside = [c & (F.rand(7 + i) < k) for i, (c, k) in enumerate(zip(inside, keep, strict=True))]
        which = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))
        return keys.select(*columns, F.explode(which).alias("_s"))

    while wide := [s for s in searches if s.size() > few]:
        sizes = [s.size() for s in wide]
        drawn = of_searches(wide, [min(1.0, SAMPLE / s.size()) for s in wide]).orderBy("_s", *order.sort()).collect()
        splitters = {(row, s.rank): s for i, s in enumerate(wide) for row in s.splitters([tuple(r)[:-1] for r in drawn if r["_s"] == i])}
        if splitters:
            counts = keys.agg(*[F.count_if(order.up_to(row, keys)).alias(f"c{i}") for i, (row, _) in enumerate(splitters)]).first()
            for ((row, _), s), n in zip(splitters.items(), counts, strict=True):
                s.learn(row, n)
        if max(sizes) <= SAMPLE and sizes == [s.size() for s in wide]:
            break  # all of them were looked at: equal rows, which no splitter parts
    if searches:
        numbered = of_searches(searches).withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(*order.sort())))
        wanted = reduce(Column.__or__, [(F.col("_s") == i) & (F.col("_r") == s.rank - s.low_rank) for i, s in enumerate(searches)])
        for r in numbered.where(wanted).collect():
            found[searches[r["_s"]].rank] = tuple(r[c] for c in columns)
    return found


def tiles(df: DataFrame, path: str, order: Order, buckets: int, name: str, few: int | None = None) -> DataFrame:
    """``df``, stored at ``path``, with ``ntile(buckets)`` over the whole table in the total order ``order``.

    The last row of each tile is found by its rank; a row's tile is one more than the number of tiles whose
    last row is before it. Nothing is sorted or shuffled but the rows around the borders.
    """
    table = write_table(df, path)
    total = table.count()
    small, larger = divmod(total, buckets)
    ends = [k * small + min(k, larger) for k in range(1, buckets)]
    borders = rows_at_ranks(table, order, ends, total, limit(df, "localRows", few))
    behind = [(~order.up_to(row, table)).cast("int") for row in borders.values()]
    return table.withColumn(name, reduce(Column.__add__, behind, F.lit(1)).cast("int"))
