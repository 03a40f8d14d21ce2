"""Ranked lexical search by NRA: sequential reads of impact-sorted postings, bounds on scores, no random access.

Query items are few next to the documents. They are taken in blocks of bounded size; for each block one pass over
the texts stores, per document, its number of terms and the frequencies of the block's terms. The numbers that the
weights need (documents, terms, document frequencies) are aggregated from that table.

A task then reads the stored rows in shards of documents. A shard's postings are sorted by impact within each term. For
each item the lists of its terms are read side by side, each time twice as deep as before. A document's score
is at least the sum of what was read of it, and at most that plus the last impact read of every list in which
it has not been met. Reading goes on until every document that could still be among the best, ties
included, has one possible score. The k-th best score so far, of this shard and of the ones before it
in the task, is the mark to beat. Documents lie in one shard each, so the best of all are the best of the
tasks' bests, which Spark ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import fresh_path
from .text import give_back, in_slices

BLOCK_BYTES = 4 << 20  # text of the items of one block, on average
STEP_BYTES = 4 << 20  # text that is split at a time
SHARD_POSTINGS = 1_000_000  # postings that are sorted and read together
FIRST_DEPTH = 64
# Bytes of terms: digits, letters (upper case becomes lower) and all bytes beyond ASCII. Others part terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


class Queries:
    """The items of a block: numbers of their terms, and how often each item has them."""

    def __init__(self, texts: list[bytes]):
        self.terms: dict[bytes, int] = {}
        self.items = []
        for text in texts:
            counts = Counter(self.terms.setdefault(t, len(self.terms)) for t in terms(text))
            self.items.append((np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))


def weights(documents: int, frequencies: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) by number of a term; a term that no document has gets none."""
    out = np.zeros(size, np.int64)
    for term, df in frequencies.items():
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return out


class Shard:
    """Postings of some documents, sorted by impact within each term."""

    def __init__(self, sizes: np.ndarray, many: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, length: int, known: int):
        self.documents = len(sizes)
        doc = np.repeat(np.arange(len(sizes)), many)
        norm = 100 - 25 + 25 * sizes * documents // max(1, length)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(known + 1))

    def best(self, item: tuple[np.ndarray, np.ndarray], weight: np.ndarray, k: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with final scores: all of at least the k-th best score and ``mark``."""
        term, times = item
        factor = weight[term] * times
        low, high = self.starts[term], self.starts[term + 1]
        used = (factor > 0) & (high > low)
        factor, low, high = factor[used], low[used], high[used]
        score = np.zeros(self.documents, np.int64)
        depth, read = FIRST_DEPTH, low
        while len(factor):
            to = np.minimum(low + depth, high)
            np.add.at(score, self._docs(read, to), np.repeat(factor, to - read) * self._taken(self.impact, read, to))
            read, depth = to, 2 * depth
            # What a document can still get from a list in which it was not met.
            ceiling = np.where(read < high, factor * self.impact[read - 1], 0)
            open_ = ceiling > 0
            if not open_.any():
                break
            more = np.full(self.documents, ceiling.sum())
            np.subtract.at(more, self._docs(low[open_], read[open_]), np.repeat(ceiling[open_], (read - low)[open_]))
            goal = max(mark, int(np.partition(score, -k)[-k]) if self.documents >= k else 0)
            unsure = more > 0
            if goal > 0 and (not unsure.any() or (score + more)[unsure].max() < goal):
                score[unsure] = 0  # below the goal whatever comes
                break
        goal = max(mark, 1, int(np.partition(score, -k)[-k]) if self.documents >= k else 1)
        found = np.flatnonzero(score >= goal)
        return found, score[found]

    @staticmethod
    def _taken(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        many = high - low
        return values[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def _docs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self._taken(self.doc, low, high)


def postings(docs: DataFrame, queries, key: str, text: str) -> DataFrame:
    """Stored: ``key``, number of terms ``n``, and the frequencies of the block's terms; documents without terms have no row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.DataType.fromDDL("n bigint, terms array<int>, tfs array<int>")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = queries.value.terms
        known = max(1, len(numbers))
        for batch in batches:
            at = 0
            for part in in_slices(batch.column(1), STEP_BYTES):
                found, sizes, many = [], [], []
                for text in part.cast(pa.large_binary()).to_pylist():
                    own = terms(text or b"")
                    hits = [numbers[t] for t in own if t in numbers]
                    sizes.append(len(own))
                    many.append(len(hits))
                    found += hits
                code = np.repeat(np.arange(len(part)), many) * known + np.array(found, np.int64)
                code, tf = np.unique(code, return_counts=True)
                bounds = pa.array(np.searchsorted(code, np.arange(len(part) + 1) * known), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (code % known, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), *lists], names=schema.names)
                at += len(part)
                yield rows.filter(pc.greater(rows.column(1), 0))
            give_back()

    path = fresh_path(docs.sparkSession, "postings")
    docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(count, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def best_of_tasks(stored: DataFrame, queries, weight: np.ndarray, documents: int, length: int, k: int, key: str) -> DataFrame:
    """``__item`` (its number), ``key``, ``score``: the k best of each task, by score and key."""
    schema = T.StructType([T.StructField("__item", T.IntegerType()), T.StructField(key, stored.schema[key].dataType), T.StructField("score", T.LongType())])
    order = [("__item", "ascending"), ("score", "descending"), ("__key", "ascending")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = queries.value.items, len(queries.value.terms)
        best, mark = None, [0] * len(items)
        for shard_rows in _shards(batches) if items else ():
            lists = [shard_rows.column(c).combine_chunks() for c in (2, 3)]
            many = pc.list_value_length(lists[0]).to_numpy()
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            shard = Shard(shard_rows.column(1).to_numpy(), many, term, tf, documents, length, known)
            found = [shard.best(item, weight, k, m) for item, m in zip(items, mark, strict=True)]
            number = np.repeat(np.arange(len(items)), [len(x) for x, _ in found])
            docs, score = (np.concatenate(x) for x in zip(*found, strict=True))
            new = pa.table({"__item": pa.array(number, pa.int32()), "__key": shard_rows.column(0).take(pa.array(docs)), "score": pa.array(score)})
            best = (pa.concat_tables([best, new]) if best else new).sort_by(order)
            number, score = best.column("__item").to_numpy(), best.column("score").to_numpy()
            firsts = np.searchsorted(number, np.arange(len(items) + 1))
            rank = np.arange(len(number)) - firsts[number]
            for i in number[rank == k - 1]:
                mark[i] = int(score[firsts[i] + k - 1])
            best = best.filter(pa.array(rank < k))
            give_back()
        if best is not None:
            for batch in best.select(["__item", "__key", "score"]).rename_columns(schema.names).to_batches():
                yield batch

    return stored.mapInArrow(search, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with about SHARD_POSTINGS postings, a row at least."""
    held, many = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + SHARD_POSTINGS - many, side="right")))
            held.append(batch.slice(at, end - at))
            many += int(ends[end - 1] - before)
            at = end
            if many >= SHARD_POSTINGS or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, many = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item``, ``rank`` from 1, ``key``, ``score``.

    Only scores above 0 count; equal scores go by ascending key, a null key last. Null and empty texts have no terms.
    Repeated rows of ``docs`` are ranked each; equal rows of ``items`` give one list, rows of one item id with
    different texts a list each. Other columns do not matter; without documents or items the result is empty.
    Memory grows with the largest text and, in the search, with one shard.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("__id"), F.col(item_text).alias("__text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        queries = spark.sparkContext.broadcast(Queries([(r["__text"] or "").encode() for r in rows]))
        stored = postings(docs, queries, key, text)
        documents, length = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row for each term of the block at most.
        frequencies = dict(map(tuple, stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
        weight = weights(documents, frequencies, len(queries.value.terms))
        found = best_of_tasks(stored, queries, weight, documents, length, k, key)
        ids = spark.createDataFrame([(i, r["__id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("__item", T.IntegerType()), T.StructField("__id", asked.schema["__id"].dataType)]))
        ordered = Window.partitionBy("__item").orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
        # The block's items, bounded as above.
        named = best.join(F.broadcast(ids), "__item").select(F.col("__id").alias(item), "rank", key, "score")
        out = named if out is None else out.unionByName(named)
    return out
