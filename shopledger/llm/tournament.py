"""Packing of documents into token sequences by first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut at multiples of the capacity; what is left of it goes into shared sequences. Pieces are dealt
into groups at random, by a number that each got when it was stored, so a group is a sample of all lengths
whatever keys, copies or sources the pieces have. Each group is packed by itself: longest piece first, each into the
first bin with room for it, found by walking down a tree whose nodes hold the largest room below them.

First fit leaves gaps. The bins that are filled least are taken apart and their pieces cut into the gaps of the others;
what remains, less than one sequence a group, is cut into sequences whose lengths are powers of two, which need
no padding. So no sequence is padded if the capacity is a sequence's full length.

Only numbers are shuffled. A piece's checksum is made where its text is encoded; the ids are stored once and are
read again for the few pieces that were cut later.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from .text import give_back, in_slices
from .tokenizers import Tokenizer

STEP_BYTES = 4 << 20  # text that is encoded at a time
GROUP_PIECES = 50_000  # pieces that one task packs together, on average
BROADCAST_CUTS = 200_000  # cut pieces (four numbers each) that are sent to every task; beyond that they are joined
SPELLED = {"start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint"}
PLACED = {"sequence_id": "bigint", "offset": "bigint"}


class Rooms:
    """Tournament tree over the rooms of bins; all bins exist from the start and are empty."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with room for ``need``; it takes it."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < need:
                node += 1
        found = node - self.leaves
        most[node] -= need
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            larger = left if left > right else right
            if most[node] == larger:
                break
            most[node] = larger
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pieces (by place in ``lengths``) of each bin, in the order in which they went in."""
    rooms, bins = Rooms(len(lengths), capacity), []
    for piece in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        found = rooms.first_with(lengths[piece])
        if found == len(bins):
            bins.append([])
        bins[found].append(piece)
    return bins


def packed_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Parts (piece, first id in it, length, sequence, offset) of pieces of 1 to ``capacity`` ids."""
    bins = first_fit_decreasing(lengths, capacity)
    fill = [sum(lengths[p] for p in own) for own in bins]
    order = sorted(range(len(bins)), key=fill.__getitem__, reverse=True)
    full, rest = divmod(sum(fill), capacity)
    out = []
    spare = [p for b in order[full:] for p in bins[b]]
    spare.sort(key=lengths.__getitem__)
    used = 0  # ids of the last spare piece that are placed

    def pour(sequence: int, offset: int, room: int) -> None:
        nonlocal used
        while room:
            piece = spare[-1]
            part = min(room, lengths[piece] - used)
            out.append((piece, used, part, sequence, offset))
            used, offset, room = used + part, offset + part, room - part
            if used == lengths[piece]:
                spare.pop()
                used = 0

    for sequence, b in enumerate(order[:full]):
        offset = 0
        for p in bins[b]:
            out.append((p, 0, lengths[p], sequence, offset))
            offset += lengths[p]
        pour(sequence, offset, capacity - offset)
    sequence = full
    for size in (1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1):
        pour(sequence, 0, size)
        sequence += 1
    return out


def _named(kinds: dict[str, str]) -> list[T.StructField]:
    return [T.StructField(n, T.DataType.fromDDL(t)) for n, t in kinds.items()]


def token_pieces(docs: DataFrame, tokenizer: Tokenizer, capacity: int, separator: int, key: str, text: str) -> DataFrame:
    """Stored pieces: ``key``, start, length, CRC-32, tokens of the document, and the ids of pieces below the capacity."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *_named(SPELLED), *_named({"__ids": "binary"})])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer.model()
        for batch in batches:
            done = 0
            for part in in_slices(batch.column(1), STEP_BYTES):
                rows, numbers, left = [], [], []
                for row, ids in enumerate(model.encode([x or "" for x in part.to_pylist()])):
                    ids.append(separator)
                    own = np.array(ids, "<u4")
                    for at in range(0, len(ids), capacity):
                        cut = own[at : at + capacity]
                        rows.append(done + row)
                        numbers.append((at, len(cut), zlib.crc32(cut), len(ids)))
                        left.append(cut.tobytes() if len(cut) < capacity else None)
                done += len(part)
                columns = [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns, pa.array(left, pa.binary())], names=schema.names)
                give_back()

    path = fresh_path(docs.sparkSession, "token-pieces")
    rows = docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(pieces, schema)
    # The number of a row; stored, so that it stays whatever is computed again.
    rows.withColumn("__row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def placed(pieces: DataFrame, capacity: int, key: str) -> DataFrame:
    """Stored parts of the pieces with sequence and offset; the checksum of a part of a piece is null."""
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    rows = pieces.drop("__ids").withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    fields = [f for f in rows.schema.fields if f.name != "__group"] + _named({"__from": "bigint"} | PLACED)

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")  # the same packing whatever the order of arrival
        parts = packed_group(table.column("length").to_pylist(), capacity)
        piece, first, length, sequence, offset = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        out = table.take(pa.array(piece))
        was, start, crc = (out.column(c).to_numpy() for c in ("length", "start", "ids_crc32"))
        new = {"start": start + first, "length": length, "ids_crc32": pa.array(crc, mask=length < was), "__from": first}
        new |= {"sequence_id": (group[0].as_py() << 32) + sequence, "offset": offset}
        columns = [pa.array(new[f.name]) if f.name in new else out.column(f.name) for f in fields]
        return pa.table(columns, names=[f.name for f in fields])

    path = fresh_path(pieces.sparkSession, "placed")
    rows.groupBy("__group").applyInArrow(pack, T.StructType(fields)).write.parquet(path)
    return pieces.sparkSession.read.parquet(path)


def _checksum(ids: Column, first: Column, length: Column) -> Column:
    @F.arrow_udf("bigint")
    def checksum(ids: pa.Array, first: pa.Array, length: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), first.to_pylist(), length.to_pylist(), strict=True)
        return pa.array([zlib.crc32(x[4 * a : 4 * (a + n)]) for x, a, n in rows], pa.int64())

    return checksum(ids, first, length)


def pack_documents(
    docs: DataFrame, tokenizer: Tokenizer, capacity: int = 2048, separator: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Columns: ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``. A document's ids end with ``separator``; each is in one piece. Every sequence has
    ``capacity`` tokens or a power of two. A null text counts as empty and has the separator alone; null or
    repeated keys and repeated rows give pieces for each row; other columns of ``docs`` do not matter; an
    empty table gives an empty one. Memory grows with the largest text.
    """
    pieces = token_pieces(docs, tokenizer, capacity, separator, key, text)
    parts = placed(pieces, capacity, key)
    columns = [key, *SPELLED, *PLACED]
    cut = parts.where("ids_crc32 is null")
    few = cut.count() <= BROADCAST_CUTS
    # Cut pieces are few by nature (about one for each bin with a gap); their number is looked at all the same.
    needed = cut.select(*columns, "__from", F.col("__row").alias("__of"))
    ids = pieces.select("__row", "__ids")
    joined = ids.join(F.broadcast(needed) if few else needed, F.col("__row") == F.col("__of"))
    summed = joined.withColumn("ids_crc32", _checksum(F.col("__ids"), F.col("__from"), F.col("length"))).select(*columns)
    return parts.where("ids_crc32 is not null").select(*columns).unionByName(summed)
