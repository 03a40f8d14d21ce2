"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

A fingerprint has a bit set if more than half of the shingle hashes have it. Two texts are linked if their
fingerprints differ in ``max_bits`` bits at most. Only distinct fingerprints are compared, one row each,
however many copies a text has.

Finding pairs: a fingerprint is parted into ``max_bits + 2`` blocks; two fingerprints within the distance
agree in two of the blocks at least, so rows that share a pair of blocks meet. For each fingerprint the
distances to ``PIVOTS`` reference fingerprints are precomputed; by the triangle inequality a pair whose
distances to one pivot differ by more than ``max_bits`` cannot be linked, so pairs with a larger maximum
coordinate difference are discarded, and the survivors are verified bit by bit.

Crowded meetings (more than ``CROWD`` fingerprints with the same pair of blocks, as families of near copies
make) would emit pairs by the square of their size. There, exact half-way keys replace pairs: fingerprints
x and y differ in ``2 r`` bits at most just if some z lies within r bits of both, so each row names all z
within r bits of itself and rows that name the same z are joined to the smallest of them. Rows grow with the number of
fingerprints only, and no link is lost, since links enter the result through their components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from .components import components
from .text import as_bytes, by_slices, unused, words

SEED = 42
PIVOTS = 16
CROWD = 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: bytes, size: int) -> int:
    """Majority bits of the hashes of all shingles of ``size`` words, A-Z lower-cased, as a signed number."""
    tokens = words(text.lower())
    if not tokens:
        return 0
    if len(tokens) > size:
        tokens = list(map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False)))
    else:
        tokens = [b" ".join(tokens)]
    hashes = np.fromiter(map(_hash, tokens), "<u8", len(tokens))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(tokens) < 256:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        # Votes of a bit: how often each value of its byte occurs, for the values that have the bit.
        votes = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(votes * 2 > len(tokens), bitorder="little").view("<i8")[0])


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def fingerprint(text: Column, size: int = 3) -> Column:
    """SimHash of a text as bigint; a text without words, or null, has 0."""

    @F.arrow_udf("bigint")
    def prints(column: pa.Array) -> pa.Array:
        return by_slices(column, lambda part: pa.array([fingerprint_of(t, size) for t in as_bytes(part)], pa.int64()), pa.int64())

    return prints(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, spread by a fixed rule."""
    return [xxhash.xxh64_intdigest(str(i).encode(), SEED) - (1 << 63) for i in range(n)]


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks of nearly equal size."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(value: Column, blocks: list[tuple[int, int]]) -> Column:
    """The value with all bits outside the blocks cleared."""
    mask = sum(((1 << bits) - 1) << first for first, bits in blocks)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _meetings(prints: DataFrame, max_bits: int) -> DataFrame:
    """A row for each fingerprint and pair of blocks: ``which``, ``part``, ``f``, ``pivots``."""
    parts = [F.struct(F.lit(i).alias("which"), _part(F.col("f"), list(two)).alias("part")) for i, two in enumerate(combinations(_blocks(max_bits + 2), 2))]
    table = F.array(*(F.bit_count(F.col("f").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots()))
    rows = prints.select("f", table.alias("pivots"), F.explode(F.array(*parts)).alias("_m"))
    return rows.select("f", "pivots", "_m.which", "_m.part")


def _pair_links(light: DataFrame, max_bits: int) -> DataFrame:
    other = light.select("which", "part", F.col("f").alias("g"), F.col("pivots").alias("other"))
    apart = F.greatest(*(F.abs(F.col("pivots")[i] - F.col("other")[i]) for i in range(PIVOTS)))
    near = light.join(other, ["which", "part"]).where((F.col("f") < F.col("g")) & (apart <= max_bits))
    return near.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits).select("f", "g")


def _half_way_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links of crowded fingerprints to the smallest one with the same half-way key."""
    reach = (max_bits + 1) // 2
    flips = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(64), n)]
    if max_bits % 2 or len(flips) > 3000:
        raise ValueError("half-way keys need an even distance of 4 bits at most")
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in flips))
    keys = crowded.select("f").distinct().select("f", F.explode(masks).alias("_mask")).select("f", F.col("f").bitwiseXOR(F.col("_mask")).alias("z"))
    low = keys.groupBy("z").agg(F.min("f").alias("g"), F.max("f").alias("_top")).where("g < _top")
    return keys.join(low, "z").where("f <> g").select("f", "g")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (f, g) between distinct fingerprints whose components are those of all pairs within ``max_bits`` bits.

    ``prints`` is a stored table with one row per distinct fingerprint ``f``.
    """
    meetings = _meetings(prints, max_bits)
    sizes = meetings.groupBy("which", "part").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = meetings.join(sizes, ["which", "part"])
    light = met.where(F.col("_n") <= CROWD).drop("_n")
    return _pair_links(light, max_bits).unionAll(_half_way_links(met.where(F.col("_n") > CROWD), max_bits))


def _grouped(docs: DataFrame, size: int, max_bits: int, key: str, text: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Stored rows (id, f, more) of the documents, and (f, low, root) for each distinct fingerprint, with its smallest key."""
    spark = docs.sparkSession
    path = fresh_path(spark, "fingerprints")
    docs.select(F.col(key).alias("id"), fingerprint(F.col(text), size).alias("f"), *more).write.parquet(path)
    rows = spark.read.parquet(path)
    distinct = fresh_path(spark, "fingerprints")
    rows.groupBy("f").agg(F.min("id").alias("low")).write.parquet(distinct)
    prints = spark.read.parquet(distinct)
    roots = components(links(prints, max_bits), "f", "g")
    return rows, prints.join(roots, prints["f"] == roots["node"], "left").select("f", "low", F.coalesce("root", "f").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, ``fingerprint`` as bigint, ``component_id``), one for each row of ``docs``.

    ``component_id`` is the smallest key reachable over links, the own one included; keys that are null count
    as larger than all others, and a group of null keys only has a null id. Rows of equal text always share a
    component; texts without words (empty or null too) have fingerprint 0. Repeated keys are kept row by row. Keys are of any
    type with an order; other columns do not matter; an empty table gives an empty one. Texts pass once; the fingerprints (a number each) are stored under the shared folder.
    """
    rows, grouped = _grouped(docs, size, max_bits, key, text)
    # The smallest key of a component: combined before the shuffle, so a large component is no hot group.
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("f", "component_id")
    return rows.join(named, "f").select(F.col("id").alias(key), F.col("f").alias("fingerprint"), "component_id")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _hashable(field: T.StructField) -> Column:
    """A column that hashes take: maps, which they refuse, as text."""
    return F.to_json(F.struct(field.name)) if _has_map(field.dataType) else F.col(field.name)


def keep_first(docs: DataFrame, size: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, null keys last (of repeated keys, that of the smallest digest).

    Rows are told apart by a digest of 128 bits of all their columns, of any type, so keys may be null or repeated.
    """
    values = [x for f in docs.schema.fields for x in (F.col(f.name).isNull(), _hashable(f))]
    one, two, many, whole = unused(docs, "__first", "__second", "__n", "__row")
    marks = F.xxhash64(*values).alias(one), F.xxhash64(F.lit(1), *values).alias(two)
    rows, grouped = _grouped(docs, size, max_bits, key, text, *marks)
    # Minima are combined before each shuffle, so neither a fingerprint nor a component of very many rows is a hot group.
    low = rows.groupBy("f").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", one, two)).alias("row"))
    kept = grouped.join(low, "f").groupBy("root").agg(F.min("row").alias("row")).select(f"row.{one}", f"row.{two}")
    again = rows.groupBy(one, two).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1)
    kept = kept.join(again, [one, two], "left")
    found = docs.select("*", *marks).join(kept, [one, two])
    # Equal rows: any of them, chosen before the shuffle too.
    equal = found.where(F.col(many) > 1).groupBy(one, two).agg(F.first(F.struct(*docs.columns)).alias(whole))
    return found.where(F.col(many).isNull()).select(*docs.columns).unionAll(equal.select(f"{whole}.*"))
