"""Most frequent partner of every item over groups (co-purchase), without all pairs of a huge group.

Groups of at most ``wide`` rows are listed as arrays and emit their pairs: at most ``wide / 2`` pairs
per input row, so that work is linear in the rows. Wider groups emit no item pairs. Their items are dealt into blocks,
and shared groups are counted tile by tile, a tile being a pair of blocks: a sparse matrix product, group by
group, into a small table of counts. A tile holds all groups with items in both of its blocks, and of the narrow groups
the counts of its pairs, so its counts are final and only the best partner of each of its items leaves it. A task sees the
part of a group that lies in its two blocks. Both kinds of groups are exact.

There are as many tiles as it takes for each to count ``tileItems`` squared pairs at most. Where nearly all items meet,
that is the square of the items; where most never do, it follows the number of pairs that do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, freed_shuffles, limit
from .skew import HEAVY_SHARE, HeavyKeys, heavy_keys, spread_join, with_parts

PAIRS = 2_000_000  # pairs of a tile that are counted at a time
DENSE = 4_000_000  # cells of a tile that is counted in a full table


def _as_arrays(rows: DataFrame, *group: str) -> DataFrame:
    """The items of each group, sorted: ``lines`` with repeats and ``items`` without."""
    listed = rows.groupBy(*group).agg(F.sort_array(F.collect_list("i")).alias("lines"))
    return listed.select("lines", F.array_distinct("lines").alias("items"))


def _split(rows: DataFrame, heavy: HeavyKeys, wide: int) -> tuple[DataFrame, DataFrame]:
    """(narrow groups as sorted arrays, rows of wide groups) of rows (g, i); one shuffle of the rows."""
    dealt = with_parts(rows, heavy, "g").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("i"), F.col("parts").cast("bigint"))).otherwise(0)
    )
    # A group that is not heavy has all its rows in part 0, so this is its exact row count.
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g", "part")))
    is_narrow = (F.col("parts") == 1) & (F.col("n") <= wide)
    return _as_arrays(counted.where(is_narrow), "g", "part"), counted.where(~is_narrow).select("g", "i")


def _tally(narrow: DataFrame) -> DataFrame:
    """Narrow groups in one pass: (a, b, n) with n groups holding a < b, and (a, NULL, n, size).

    The second kind has the number of rows of ``a`` and the summed group size over those rows.
    """
    count = F.size("items").cast("bigint")
    item = narrow.select("lines", "items", count.alias("size"), F.posexplode("items").alias("at", "a"))
    rows = (F.size("lines") - F.size(F.array_remove("lines", F.col("a")))).cast("bigint")
    later = F.slice("items", F.col("at") + 2, F.size("items"))
    nothing = F.array(F.lit(None).cast(narrow.schema["items"].dataType.elementType))
    emitted = item.select("a", rows.alias("rows"), "size", F.explode(F.concat(nothing, later)).alias("b"))
    own = F.col("b").isNull()
    return emitted.groupBy("a", "b").agg(
        F.sum(F.when(own, F.col("rows")).otherwise(1)).alias("n"), F.sum(F.when(own, F.col("size") * F.col("rows"))).alias("size")
    )


def _rank(n: Column, partner: Column) -> Column:
    """Orders by count descending, then partner ascending."""
    return F.struct((-n).alias("n"), partner.alias("p"))


def _both_ways() -> Column:
    """Candidates of a pair (a, b, n) for both of its items."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    return F.array(
        F.struct(a.alias("i"), _rank(n, b).alias("best")),
        F.struct(b.alias("i"), _rank(n, a).alias("best")),
    )


class _Side:
    """Members of one block: group number and place of each, by group."""

    def __init__(self, group: np.ndarray, lists: pa.ListArray, groups: int):
        order = np.argsort(group, kind="stable")
        lists = lists.take(pa.array(order))
        many = pc.list_value_length(lists).to_numpy()
        self.place = lists.flatten().to_numpy().astype(np.int64)
        self.group = np.repeat(group[order], many)
        self.sizes = np.bincount(self.group, minlength=groups)
        self.starts = np.cumsum(self.sizes) - self.sizes


def _pair_chunks(rows: _Side, columns: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all (row item, column item) that share a group, PAIRS at a time."""
    times = columns.sizes[rows.group]
    ends = np.cumsum(times)
    at = 0
    while at < len(times):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        many = times[at:stop]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(rows.place[at:stop], many), columns.place[np.repeat(columns.starts[rows.group[at:stop]], many) + inside]
        at = stop


BEST = "block int, place int, other_block int, other_place int, n bigint"


def _best_in_tile(tile: tuple, members: pa.Table, narrow: pa.Table) -> pa.Table:
    """The best partner of each item of block p in block q and, in another table row, the other way round."""
    p, q = tile[0].as_py(), tile[1].as_py()
    if not members.num_rows:  # no shared wide group: counts of narrow groups are final as they are
        return _best_rows(*[np.zeros(0, np.int64)] * 3, p, q)
    group = members.column("g").combine_chunks().dictionary_encode()
    numbers, block = group.indices.to_numpy(), members.column("block").to_numpy()
    lists = members.column("at").combine_chunks()
    sides = [_Side(numbers[block == b], lists.filter(pa.array(block == b)), len(group.dictionary)) for b in (p, q)]
    row, column, n = (narrow.column(c).to_numpy() for c in ("row", "column", "n"))
    height = max(int(sides[0].place.max(initial=-1)), int(row.max(initial=-1))) + 1
    width = max(int(sides[1].place.max(initial=-1)), int(column.max(initial=-1))) + 1
    if p == q:
        height = width = max(height, width)
        row, column, n = np.concatenate([row, column]), np.concatenate([column, row]), np.concatenate([n, n])
    codes, counts = (_dense if height * width <= DENSE else _sparse)(_pair_chunks(*sides), row.astype(np.int64) * width + column, n, height * width, width)
    row, column = codes // width, codes % width
    if p == q:
        other = row != column
        return _best_rows(row[other], column[other], counts[other], p, q)
    return pa.concat_tables([_best_rows(row, column, counts, p, q), _best_rows(column, row, counts, q, p)])


def _dense(chunks: Iterator, codes: np.ndarray, n: np.ndarray, cells: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (row * width + column) with their counts, from pairs and from counted ones."""
    counts = np.zeros(cells, np.int64)
    for row, column in chunks:
        counts += np.bincount(row * width + column, minlength=cells)
    np.add.at(counts, codes, n)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _sparse(chunks: Iterator, codes: np.ndarray, n: np.ndarray, cells: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_dense``, in memory that follows the cells that are met and not all of the tile."""
    found, counts = _added(codes, n)
    parts, held = [], 0
    for row, column in chunks:
        parts.append(np.unique(row * width + column, return_counts=True))
        held += len(parts[-1][0])
        if held > max(2 * PAIRS, len(found)):
            found, counts = _added(*(np.concatenate(x) for x in zip((found, counts), *parts, strict=True)))
            parts, held = [], 0
    return _added(*(np.concatenate(x) for x in zip((found, counts), *parts, strict=True)))


def _added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their sums."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _best_rows(place: np.ndarray, partner: np.ndarray, n: np.ndarray, block: int, other: int) -> pa.Table:
    # The first of equal counts; places within a block follow the order of the items.
    order = np.lexsort((partner, -n, place))
    best = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
    columns = [np.full(len(best), block), place[best], np.full(len(best), other), partner[best]]
    return pa.table([*(pa.array(c, pa.int32()) for c in columns), pa.array(n[best], pa.int64())], names=[c.split()[0] for c in BEST.split(", ")])


def _blocks(items: int, rows: int, pairs: int, tile_items: int, tile_rows: int) -> int:
    """Blocks of items, so that a tile of two has ``tile_items`` squared cells or pairs and ``tile_rows`` rows at most.

    ``pairs`` counts each pair in both directions.
    """
    by_pairs = math.isqrt(max(0, pairs - 1)) // tile_items + 1
    return max(1, min(-(-items // tile_items), by_pairs), -(-2 * rows // tile_rows))


def _tile_candidates(pairs: DataFrame, members: DataFrame, tile_items: int, tile_rows: int) -> DataFrame:
    """(i, best): for every item of a wide group its best partner in each block, counted over all groups."""
    items = members.groupBy("i").agg(F.lit(1))
    size = F.col("size")
    rows, met = members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * size), F.lit(0))).first()
    blocks = _blocks(items.count(), rows, met + 2 * pairs.count(), tile_items, tile_rows)
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    within = Window.partitionBy("block").orderBy("i")
    items = _stored(items.select("i", block.alias("block")).withColumn("place", F.row_number().over(within) - 1), "items")
    parts = members.join(items, "i").groupBy("g", "block").agg(F.collect_list("place").alias("at"))
    # A group goes to the tiles of its own blocks, of which there are as many as it has items at most.
    others = parts.groupBy("g").agg(F.collect_set("block").alias("others"))
    tiles = parts.join(others, "g").select("g", "block", "at", F.explode("others").alias("other")).select(
        F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "g", "block", "at"
    )
    one, two = (items.select(F.col("i").alias(n), F.col("block").alias(f"block_{n}"), F.col("place").alias(f"place_{n}")) for n in "ab")
    ordered = F.col("block_a") <= F.col("block_b")
    narrow = (
        pairs.join(one, "a")
        .join(two, "b")
        .select(
            F.least("block_a", "block_b").alias("tile_p"),
            F.greatest("block_a", "block_b").alias("tile_q"),
            F.when(ordered, F.col("place_a")).otherwise(F.col("place_b")).alias("row"),
            F.when(ordered, F.col("place_b")).otherwise(F.col("place_a")).alias("column"),
            "n",
        )
    )
    best = tiles.groupBy("p", "q").cogroup(narrow.groupBy("tile_p", "tile_q")).applyInArrow(_best_in_tile, BEST)
    partner = items.select(F.col("i").alias("partner"), F.col("block").alias("other_block"), F.col("place").alias("other_place"))
    named = best.join(items, ["block", "place"]).join(partner, ["other_block", "other_place"])
    return named.select("i", _rank(F.col("n"), F.col("partner")).alias("best"))


def top_partners(
    lines: DataFrame,
    group: str,
    item: str,
    wide: int | None = None,
    min_rows: int | None = None,
    share: float = HEAVY_SHARE,
    all_lines: DataFrame | None = None,
) -> DataFrame:
    """Per item: ``partner`` seen in most of its groups, ``together`` = number of those groups.

    Ties go to the smallest partner. Also ``mean_group_size``: the mean, over the item's rows, of the
    number of distinct items in the row's group. Items that never share a group have NULL partner.

    Group sizes are looked at first, to see whether wide groups exist at all. ``all_lines`` may name a
    cheaper frame that contains all rows of ``lines`` for that look; more rows only widen the search.
    """
    wide = limit(lines, "wideGroup", wide)
    rows = lines.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null")
    seen = (all_lines if all_lines is not None else lines).select(F.col(group).alias("g"))
    sizes = seen.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    any_wide = not sizes.where((F.col("n") > wide) & F.col("g").isNotNull()).isEmpty()
    heavy = heavy_keys(seen, "g", min_rows, share) if any_wide else HeavyKeys(seen.schema["g"].dataType, ())

    if any_wide:
        narrow, wide_rows = _split(rows, heavy, wide)
        totals = _with_wide_groups(_tally(narrow), wide_rows, heavy)
    else:
        tally = _tally(_as_arrays(rows, "g"))
        one = F.array(F.struct(F.col("a").alias("i"), F.lit(None).cast(_rank_type(tally)).alias("best")))
        ends = tally.select(
            F.explode(F.when(F.col("b").isNull(), one).otherwise(_both_ways())).alias("e"),
            F.when(F.col("b").isNull(), F.col("n")).alias("rows"),
            "size",
        )
        totals = ends.groupBy("e.i").agg(
            F.min("e.best").alias("best"),
            # A pair shows up under both items without rows and size; those are NULL here.
            F.sum("rows").alias("rows"),
            F.sum("size").alias("size"),
        )
    return totals.select(
        F.col("i").alias(item),
        F.col("best.p").alias("partner"),
        (-F.col("best.n")).alias("together"),
        (F.col("size").cast("double") / F.col("rows")).alias("mean_group_size"),
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rank_type(tally: DataFrame):
    return tally.select(_rank(F.col("n"), F.col("b")).alias("r")).schema["r"].dataType


def _with_wide_groups(tally: DataFrame, wide_rows: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """(i, best, rows, size) over narrow and wide groups together."""
    # Each part is read several times below; stored, the lines are read once.
    members = _stored(wide_rows.groupBy("g", "i").agg(F.count(F.lit(1)).alias("rows")), "members")
    tally = _stored(tally, "tally")
    widths = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    in_wide = spread_join(members, widths, "g", "i", "inner", heavy=heavy).select(
        "i", "rows", (F.col("size") * F.col("rows")).alias("size")
    )
    in_narrow = tally.where("b is null").select(F.col("a").alias("i"), F.col("n").alias("rows"), "size")
    stats = in_narrow.unionByName(in_wide).groupBy("i").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    pairs = tally.where("b is not null")
    # A pair's count in narrow groups alone is too small where it shares wide ones, and then loses to its tile's.
    met = pairs.select(F.explode(_both_ways()).alias("e")).select("e.i", "e.best")
    shared = _tile_candidates(pairs, members, limit(tally, "tileItems"), limit(tally, "tileRows"))
    best = met.unionByName(shared).groupBy("i").agg(F.min("best").alias("best"))
    return stats.join(best, "i", "left")

