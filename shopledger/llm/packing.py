"""Best-fit packing of documents into sequences of a fixed token capacity, planned over a histogram of lengths.

Documents longer than the capacity are cut into pieces; nothing else is cut. The histogram of piece lengths
has at most ``capacity`` rows, whatever the number of documents, so it is the only thing the driver sees.
Best fit (longest first) runs over its counts: it hands whole runs of equal pieces to runs of equal bins.
The plan is a table of slots by (length, rank); each piece takes its slot by its rank among equal lengths.
Ranks come from counts by (length, slice), so a length that a third of all pieces share is still ranked by
many tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .bpe import STEP_BYTES, Vocabulary
from .text import give_back, in_slices

SLICE_ROWS = 200_000  # pieces that one task ranks, on average
PIECE = "struct<piece:int,start:bigint,length:int,ids_crc32:bigint>"
SLOT = "length int, low bigint, high bigint, sequence bigint, base int, per_bin int"


def cut_pieces(vocabulary: Vocabulary, text: Column, capacity: int, separator: int) -> Column:
    """Pieces of a text's ids and the separator: number, first id, ids, CRC-32 of the little-endian ids."""

    @F.arrow_udf(f"array<{PIECE}>")
    def pieces(column: pa.Array) -> pa.Array:
        model, tail = vocabulary.model(), np.array([separator], "<u4").tobytes()
        ends, piece, start, length, crc = [0], [], [], [], []
        for part in in_slices(column, STEP_BYTES):
            flat, starts = model.encode(part)
            for a, b in zip(starts, starts[1:], strict=False):
                ids = flat[a:b].tobytes() + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                ends.append(len(piece))
        give_back()
        fields = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
        rows = pa.StructArray.from_arrays(fields, names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return pieces(text)


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int, separator: int = 0, key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``; an empty text has the separator alone."""
    rows = docs.select(F.col(key), cut_pieces(vocabulary, F.col("text"), capacity, separator).alias("_p"))
    # Every text has a piece; the plain explode would add a filter that encodes all texts a second time.
    return rows.select(key, F.explode_outer("_p").alias("_p")).select(key, "_p.piece", "_p.start", "_p.length", "_p.ids_crc32")


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, low, high, sequence, base, per_bin).

    The pieces of ``length`` with rank low <= r < high go to sequence + (r - low) // per_bin, at
    base + (r - low) % per_bin * length.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first bin, bins)
    slots, bins = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a sequence of {capacity}")
        rank, left = 0, histogram[length]
        while left:
            # The tightest room that is enough; best fit fills such a bin up before it takes the next.
            room = min((r for r in open_bins if r >= length), default=capacity)
            each = room // length
            needed = -(-left // each)
            if room in open_bins:
                first, there = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                if there > needed:
                    open_bins.setdefault(room, []).append((first + needed, there - needed))
                used = min(there, needed)
            else:
                first, used = bins, needed
                bins += used
            items = min(left, used * each)
            slots.append((length, rank, rank + items, first, capacity - room, each))
            full, rest = divmod(items, each)
            for begin, n, inside in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if n and room - inside * length:
                    open_bins.setdefault(room - inside * length, []).append((begin, n))
            rank, left = rank + items, left - items
    return slots


def packed(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: a place in a sequence of at most ``capacity`` tokens.

    ``order`` ranks the pieces of one length; rows that are equal in it should be equal altogether. ``pieces``
    is read three times and should be a stored table. Lengths must be 1 to ``capacity``; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    rows = pieces.withColumn("_length", F.col(length).cast("int"))
    total = rows.count()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_ROWS))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = rows.groupBy("_length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan_slots(histogram, capacity), SLOT).withColumnRenamed("length", "_length")
    before = Window.partitionBy("_length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_length", "_slice").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["_length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before"))
    # Slots follow from lengths and rooms (capacity^2 at most, in practice a few per length): bounded, so broadcast.
    placed = ranked.join(
        F.broadcast(slots.withColumnRenamed("_length", "_of")),
        (F.col("_length") == F.col("_of")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")),
    )
    step = F.col("_rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(step / F.col("per_bin"))).withColumn(
        "offset", (F.col("base") + step % F.col("per_bin") * F.col("_length")).cast("long")
    )
    return placed.drop("_length", "_slice", "_r", "_before", "_rank", "_of", "low", "high", "sequence", "base", "per_bin")


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, separator: int = 0, key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Columns: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. A null text
    counts as empty; null or repeated keys give a row for each row; other columns of ``docs`` do not matter.
    The pieces (numbers only) are stored once under the shared folder, so texts are encoded once.
    """
    path = fresh_path(docs.sparkSession, "pieces")
    token_pieces(docs.select(key, "text"), vocabulary, capacity, separator, key).write.parquet(path)
    pieces = docs.sparkSession.read.parquet(path)
    return packed(pieces, capacity, [key, "piece", "length", "ids_crc32"])


def sequence_ids(placed: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """One row per sequence: its pieces in order and its length (a sequence holds ``capacity`` ids at most)."""
    return placed.groupBy(sequence).agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"),
        F.sum("length").alias("tokens"),
    )
