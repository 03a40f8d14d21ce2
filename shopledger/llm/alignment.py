"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizations of a text end their tokens at byte offsets. An offset where both end a token cuts the text into
independent parts. Starting from whole texts, each open interval looks for such a cut near its middle: the end of
its middle token is looked up among the other tokenizer's ends by bisection, then the ends beside it, in widths
that double. The nearest one that both share divides the interval, and both halves go on; an interval without a
shared end inside is a group. All open intervals of a batch take a step together as arrays. A stretch without
shared ends is searched once for each of its edges and once more when it is alone, so the work is linear in the
tokens but for the bisection.

Within a group, a token of one side is linked to each of the other side whose bytes overlap with it. How often two ids
are linked is counted over the corpus: chunks of a few megabytes of text store their distinct id pairs with
counts, Spark sums them up by pair, and each chunk gets back the totals of the pairs it asked for. A frequent pair
is one row a chunk on its way in and out, so no pair is a hot key, and no table of pairs is broadcast. What a
document needs of it, its own distinct pairs as places in its chunk's list, is stored beside; texts are encoded once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from .slices import packed_counts, unpacked_counts
from .text import give_back, in_slices
from .tokenizers import Tokenizer, flat

CHUNK_BYTES = 3 << 20  # text whose pairs are asked for together
NAMES = ("n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")


def shared_cuts(a: np.ndarray, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``b`` has too. Both rise; ``firsts`` are places of known shared ends, the last one included."""

    def is_shared(places: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(b, a[places]), len(b) - 1)
        return b[at] == a[places]

    found = [firsts]
    low, high = np.concatenate([[-1], firsts[:-1]]), firsts
    while True:
        open_ = high - low > 1  # ends strictly between the cuts
        low, high = low[open_], high[open_]
        if not len(low):
            break
        middle = (low + high) // 2
        cut = np.where(is_shared(middle), middle, -1)
        left, width = np.flatnonzero(cut < 0), 1
        before = 0
        while len(left):
            # Ends at a distance of before + 1 to width on both sides of the middle, nearest first.
            low_end, high_end = low[left], high[left]
            steps = np.arange(before + 1, width + 1)
            sides = np.stack([middle[left, None] - steps, middle[left, None] + steps], 2).reshape(len(left), -1)
            inside = (sides > low_end[:, None]) & (sides < high_end[:, None])
            hit = np.zeros(sides.shape, bool)
            hit[inside] = is_shared(sides[inside])
            first = hit.argmax(1)
            has = hit[np.arange(len(left)), first]
            cut[left[has]] = sides[np.flatnonzero(has), first[has]]
            more = ~has & inside[:, -2:].any(1)
            left, before, width = left[more], width, 2 * width
        split = cut >= 0
        found.append(cut[split])
        low, high = np.concatenate([low[split], cut[split]]), np.concatenate([cut[split], high[split]])
        order = np.argsort(low, kind="stable")  # neighbours stay together, so lookups walk through memory
        low, high = low[order], high[order]
    return np.sort(np.concatenate(found))


class Aligned:
    """Groups and links of a batch of texts; texts without tokens (see ``aligned``) take no part."""

    def __init__(self, a_ids, a_sizes, b_ids, b_sizes, a_lengths, b_lengths):
        self.a_ids, self.b_ids, self.a_sizes, self.b_sizes = a_ids, b_ids, a_sizes, b_sizes
        self.texts = len(a_sizes)
        self.a_ends, self.b_ends = np.cumsum(a_lengths[a_ids], dtype=np.int64), np.cumsum(b_lengths[b_ids], dtype=np.int64)
        last = np.cumsum(a_sizes) - 1
        cuts = shared_cuts(self.a_ends, self.b_ends, last[a_sizes > 0]) if len(a_ids) else np.zeros(0, np.int64)
        # Tokens of either side up to the end of each group.
        self.a_cut, self.b_cut = cuts + 1, np.searchsorted(self.b_ends, self.a_ends[cuts]) + 1
        self.a_from, self.b_from = np.concatenate([[0], self.a_cut[:-1]]), np.concatenate([[0], self.b_cut[:-1]])
        if not len(cuts):
            self.a_from = self.b_from = cuts
        self.group_text = np.searchsorted(last, cuts)
        self.n_groups = np.bincount(self.group_text, minlength=self.texts)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id of A and id of B of every link."""
        single = (self.a_cut - self.a_from == 1) & (self.b_cut - self.b_from == 1)
        text, a, b = [self.group_text[single]], [self.a_from[single]], [self.b_from[single]]
        if not single.all():
            # In other groups the ends of both sides, put together, part the links.
            wide = ~single
            spans = [np.repeat(wide, n) for n in (self.a_cut - self.a_from, self.b_cut - self.b_from)]
            ends = np.union1d(self.a_ends[spans[0]], self.b_ends[spans[1]])
            first = np.searchsorted(self.a_ends, ends)
            a.append(first)
            b.append(np.searchsorted(self.b_ends, ends))
            text.append(np.searchsorted(np.cumsum(self.a_sizes), first, side="right"))
        a, b = np.concatenate(a), np.concatenate(b)
        return np.concatenate(text), self.a_ids[a], self.b_ids[b]

    def listed(self, names: "Names") -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text, in decimal ids."""
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        out = np.empty(n_a + n_b, np.int64)
        kind = np.full(n_a + n_b, names.comma)
        sizes_a, sizes_b = self.a_cut - self.a_from, self.b_cut - self.b_from
        at_a, at_b = np.arange(n_a) + np.repeat(self.b_from, sizes_a), np.arange(n_b) + np.repeat(self.a_cut, sizes_b)
        out[at_a], out[at_b] = self.a_ids, self.b_ids
        kind[self.a_cut - 1 + self.b_from], kind[self.b_cut - 1 + self.a_cut] = names.bar, names.semicolon
        spelled, ends = names.of(out + kind), np.cumsum(self.a_sizes + self.b_sizes)
        return [b"".join(spelled[end - n : end])[:-1] for n, end in zip((self.a_sizes + self.b_sizes).tolist(), ends.tolist(), strict=True)]


class Names:
    """Decimal ids with what may follow them."""

    def __init__(self, size: int):
        self.comma, self.bar, self.semicolon = 0, size, 2 * size
        self._all = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(size)]

    def of(self, places: np.ndarray) -> list[bytes]:
        return list(map(self._all.__getitem__, places.tolist()))


def _encoded(one, other, texts: list[str]):
    """Ids of both sides; texts whose joined bytes are not a space and the text on both sides get none."""
    a, b = one.encode([" " + t for t in texts]), other.encode(texts)
    for i, t in enumerate(texts):
        want = b" " + t.encode() if t else None
        if want is None or b"".join(map(one.spelled.__getitem__, a[i])) != want or b"".join(map(other.spelled.__getitem__, b[i])) != want:
            a[i], b[i] = [], []
    return *flat(a), *flat(b)


def _stored(docs: DataFrame, a: Tokenizer, b: Tokenizer, key: str, text: str, groups_as) -> DataFrame:
    """One row per document with its numbers and its pairs as places in its chunk's list, and one per chunk with that list."""
    kinds = {"__chunk": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string"}
    kinds |= {"__places": "binary", "__times": "binary", "__pairs": "array<struct<a:int,b:int,n:bigint>>"}
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.DataType.fromDDL(", ".join(f"{n} {t}" for n, t in kinds.items()))])
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pair)]

    def chunk_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = a.model(), b.model()
        lengths = [np.fromiter(map(len, m.spelled), np.int64) for m in (one, other)]
        a_ids, a_sizes, b_ids, b_sizes = _encoded(one, other, [x or "" for x in batch.column(1).to_pylist()])
        whole = Aligned(a_ids, a_sizes, b_ids, b_sizes, *lengths)
        doc, left, right = whole.links()
        wide = np.int64(len(other.spelled))
        code = left * wide + right
        # Distinct pairs of each document, and of the chunk.
        own, times = np.unique(doc * (wide * len(one.spelled)) + code, return_counts=True)
        own_doc, own_code = np.divmod(own, wide * len(one.spelled))
        codes, places = np.unique(own_code, return_inverse=True)
        totals = np.bincount(places, times, len(codes)).astype(np.int64)
        bounds = np.searchsorted(own_doc, np.arange(batch.num_rows + 1)).tolist()
        packed: list[list[bytes]] = [[], []]
        for low, high in zip(bounds, bounds[1:], strict=False):
            # Places rise within a document; their differences need few bytes.
            packed[0].append(packed_counts(np.diff(places[low:high], prepend=0)))
            packed[1].append(packed_counts(times[low:high]))
        n, chunk = batch.num_rows, uuid.uuid4().int >> 65
        listed = [x.decode() for x in whole.listed(names_of(max(len(one.spelled), len(other.spelled))))]
        links = np.bincount(doc, minlength=n)
        numbers = [np.full(n, chunk), a_sizes, b_sizes, whole.n_groups, links]
        arrays = [pa.array(x, pa.int64()) for x in numbers] + [pa.array(listed, pa.string()), *(pa.array(x, pa.binary()) for x in packed), pa.nulls(n, types[-1])]
        pairs = pa.StructArray.from_arrays([pa.array(codes // wide, pa.int32()), pa.array(codes % wide, pa.int32()), pa.array(totals)], fields=list(pair))
        asked = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pairs)
        last = [pa.array([chunk], pa.int64()), *(pa.nulls(1, t) for t in types[1:-1]), asked]
        keys = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
        return pa.RecordBatch.from_arrays([keys, *(pa.concat_arrays(x) for x in zip(arrays, last, strict=True))], names=schema.names)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_slices(batch.column(1), CHUNK_BYTES):
                yield chunk_rows(batch.slice(at, len(part)))
                at += len(part)
                give_back()

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(chunks, schema)
    path = fresh_path(docs.sparkSession, "aligned")
    shown = F.when(F.col("__pairs").isNull(), groups_as(F.col("groups"), F.col("n_a") > 0))
    rows.withColumn("groups", shown).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


_names: dict[int, Names] = {}


def names_of(size: int) -> Names:
    if size not in _names:
        _names[size] = Names(size)
    return _names[size]


def pair_counts(asked: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the corpus, and whether no other partner of ``b`` has more."""
    totals = asked.groupBy("b", "a").agg(F.sum("n").alias("count"))
    tops = totals.groupBy("b").agg(F.max("count").alias("top"))
    return totals.join(tops, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(
    docs: DataFrame,
    a: Tokenizer,
    b: Tokenizer,
    key: str = "doc_id",
    text: str = "text",
    groups_as: Callable[[Column, Column], Column] = lambda groups, has_tokens: groups,
) -> DataFrame:
    """One row per row of ``docs``: ``key`` and how the tokens of ``a`` (over a space and the text) and ``b`` fit.

    ``n_a``, ``n_b`` tokens; ``groups`` as ``a1,a2|b1;a3|b2,b3`` in decimal ids and their number ``n_groups``;
    ``n_links`` pairs of tokens that share bytes; ``n_best`` links whose id pair is linked at least as often
    in the corpus as any other pair with the same id of ``b``; ``count_sum`` the corpus counts summed over the links.
    ``groups_as`` turns (groups, whether there are tokens) into what is kept of them, such as a digest.

    Null and empty texts, and texts that a tokenizer does not spell back byte by byte, have no tokens: zeros and
    empty groups. Null or repeated keys and repeated rows give a row for each row; other columns of ``docs`` do not
    matter; an empty table gives an empty one. Memory grows with the largest text.
    """
    stored = _stored(docs, a, b, key, text, groups_as)
    asked = stored.where("__pairs is not null").select(F.col("__chunk").alias("__of"), F.explode("__pairs").alias("p")).select("__of", "p.*")
    answers = asked.select("__of", "a", "b").join(pair_counts(asked), ["a", "b"])
    rows = stored.where("n_a is not null").drop("__pairs")
    sums = {"n_best": T.LongType(), "count_sum": T.LongType()}
    first = [f for f in rows.schema.fields if f.name not in ("__chunk", "__places", "__times")]
    schema = T.StructType([*first, *(T.StructField(n, t) for n, t in sums.items())])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = right.column("a").to_numpy().astype(np.int64) << 32 | right.column("b").to_numpy()
        order = np.argsort(codes)
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        found = [[], []]
        for places, times in zip(left.column("__places").to_pylist(), left.column("__times").to_pylist(), strict=True):
            at, many = np.cumsum(unpacked_counts(places).astype(np.int64)), unpacked_counts(times).astype(np.int64)
            found[0].append(int(many[best[at]].sum()))
            found[1].append(int((many * count[at]).sum()))
        out = left.select([f.name for f in first])
        for name, values in zip(sums, found, strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return rows.groupBy("__chunk").cogroup(answers.groupBy("__of")).applyInArrow(apply, schema).select(key, *NAMES)
