"""Language-model scores by deleted interpolation.

The probability of a token is a mix of maximum-likelihood estimates c(context, token) / c(context) for the
n-gram orders 1 to ``order`` and a uniform share for what was never seen. The weights of the mix depend on how
often the longest context occurs (a bucket for each power of two) and are learned by expectation-maximisation
on held-out counts: an eighth of the training documents is scored with counts from which that eighth was
deleted. All counts come from all training documents.

Counting and lookup share one exchange. Documents lie in chunks; a chunk sends each group of the code space
its sorted distinct n-gram codes with their counts (zero for a document that is only scored), the group adds
up over the chunks and returns the totals in the same order. A frequent n-gram reaches a group once a chunk,
so it is no hot key, and no count table is ever broadcast. Single tokens go by 64-bit codes, longer n-grams by
``SPARE_BITS`` more bits than the number of tokens has: one shares its code with another with a probability of about
2^-16 (their counts are then added up), whatever the size of the corpus. The held-out eighth
has chunks of its own, which get totals without it as well; what these tell of each token is rounded to a cell
(bucket, log estimates), and EM runs over the number of tokens in each cell, a table that does not grow with
the corpus. Everything is one plan, so the documents are shuffled once for all passes.
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import group_bounds, packed_codes, packed_counts, parts_for, text_size, unpacked_codes, unpacked_counts
from .text import appended, as_bytes, give_back, named, unused, word_hashes, words

ORDER = 3
SPARE_BITS = 16  # bits of a code beyond those that number the corpus' bytes
FOLDS = 8
GROUP_CODES = 2_000_000
CELL = 0.2  # width of a cell in the logarithm of an estimate
ROUNDS = 60
# No word contains a space.
_END, _BEGIN = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" begin")


class Grams:
    """N-gram codes of the tokens of some texts: their words, A-Z lower-cased, and one end each."""

    def __init__(self, texts: list[bytes], order: int, bits: int = 64):
        parts, sizes = [], []
        self._drop = np.uint64(64 - bits)
        for text in texts:
            hashes = word_hashes(words(text.lower()))
            sizes.append(len(hashes) + 1)
            parts += [np.full(order - 1, _BEGIN, np.uint64), hashes, np.array([_END], np.uint64)]
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        place = np.arange(len(self.doc)) + (self.doc + 1) * (order - 1)
        self.codes = []
        for size in range(1, order + 1):
            run = np.zeros(len(place), np.uint64)
            for n in range(size - 1, -1, -1):
                run = appended(run, hashes[place - n])
            self.codes.append(named(run, size) >> (self._drop if size > 1 else np.uint64(0)))
        self.first = np.cumsum(self.sizes) - self.sizes

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted codes and counts of the single tokens, then of all longer n-grams together."""
        longer = np.concatenate(self.codes[1:]) if len(self.codes) > 1 else np.zeros(0, np.uint64)
        return [_tallied(self.codes[0].copy()), _tallied(longer)]

    def found(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of the n-gram of each order at each token, and of its context, from (codes, counts) tables."""
        counts = []
        for n, codes in enumerate(self.codes):
            known, many = tables[min(n, 1)]
            counts.append(many[np.searchsorted(known, codes)].astype(np.float64))
        ends = counts[0][self.first + self.sizes - 1]  # as many as documents, hence the count of the first context
        contexts = []
        for n in range(1, len(self.codes)):
            before = np.roll(counts[n - 1], 1)
            before[self.first] = ends
            contexts.append(before)
        return counts, contexts


def _tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts; sorts the given array itself, where np.unique makes copies."""
    codes.sort()
    first = np.empty(len(codes), bool)
    first[:1] = True
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    return codes[starts], np.diff(starts, append=len(codes))


def estimates(counts: list[np.ndarray], contexts: list[np.ndarray], total: float) -> list[np.ndarray]:
    """Maximum-likelihood estimates of each order."""
    out = [counts[0] / max(1.0, total)]
    return out + [c / np.maximum(1.0, h) for c, h in zip(counts[1:], contexts, strict=True)]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(context + 1)).astype(np.int64)


def learn(cells: dict[str, int], total: float, distinct: int, order: int) -> dict[str, list[float]]:
    """Weights by bucket, uniform share first, from tokens per cell ("bucket,log count,log estimate...")."""
    buckets, shares, many = [], [], []
    for cell, n in sorted(cells.items()):
        bucket, *logs = cell.split(",")
        p = [0.0 if x == "z" else math.exp(int(x) * CELL) for x in logs]
        p[0] /= max(1.0, total)
        buckets.append(int(bucket))
        shares.append([1 / (distinct + 1), *p])
        many.append(n)
    if not many:
        return {}
    kinds, own = np.unique(buckets, return_inverse=True)
    p, n = np.array(shares), np.array(many, float)
    weights = np.full((len(kinds), order + 1), 1 / (order + 1))
    for _ in range(ROUNDS):
        part = weights[own] * p
        part *= (n / part.sum(1))[:, None]
        new = np.zeros_like(weights)
        np.add.at(new, own, part)
        # A bucket of few tokens leans on all of them: ten tokens of the overall mix are added.
        overall = new.sum(0) / new.sum()
        new += 10 * overall
        weights = new / new.sum(1, keepdims=True)
    return {str(k): w.tolist() for k, w in zip(kinds, weights, strict=True)}


def _weight_table(weights: dict[str, list[float]], order: int) -> np.ndarray:
    """Weights by bucket; a bucket that was not seen takes those of the nearest one."""
    table = np.zeros((66, order + 1))
    table[:, 0] = 1.0
    if weights:
        known = np.array(sorted(map(int, weights)))
        for b in range(len(table)):
            table[b] = weights[str(known[np.abs(known - b).argmin()])]
    return table


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, one row each.

    ``train`` tells the rows to learn from. ``score`` is the model's log10 probability of the text,
    ``base_score`` that of add-one smoothed single tokens. Null texts count as empty (one end token); without
    training rows every token is unseen. Columns of the new names are replaced. ``order`` 1 or more; the
    shuffle grows with it by about the size of the text for each order.
    """
    _, size = text_size(docs, text)
    chunks = parts_for(docs, size)
    groups = max(parts_for(docs, size, 1 << 62), -(-size * order // (6 * GROUP_CODES)))
    folds, tests = max(1, chunks // FOLDS), max(1, chunks // 7)
    bits = min(64, max(1, size).bit_length() + SPARE_BITS)  # there are fewer tokens than bytes
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = docs.drop(*names)
    (chunk_name,) = unused(rows, "__chunk")
    mark = F.xxhash64(F.col(key))
    fold = F.pmod(mark, F.lit(FOLDS)) == 0

    def one_of(first: int, n: int) -> Column:
        # The text takes part, so that rows of one key, or of none, are dealt over all chunks.
        return F.lit(first) + F.pmod(F.xxhash64(F.lit(1), mark, F.col(text)), F.lit(n))

    # Chunks: the main training part, then the held-out folds, then rows that are only scored.
    learned = F.coalesce(train, F.lit(False))
    chunk = F.when(~learned, one_of(chunks + folds, tests)).when(fold, one_of(chunks, folds)).otherwise(one_of(0, chunks))
    marked = rows.withColumn(chunk_name, chunk.cast("int"))
    dealt = marked.repartition(chunk_name)

    def ask(number: tuple, table: pa.Table) -> pa.Table:
        own = number[0].as_py()
        out: dict[str, list] = {"group": [], "kind": [], "codes": [], "counts": []}
        for kind, (codes, counts) in enumerate(Grams(as_bytes(table.column(text).combine_chunks()), order, bits).distinct()):
            counts = counts if own < chunks + folds else np.zeros_like(counts)
            cuts = group_bounds(codes, groups, bits if kind else 64)
            for g in range(groups):
                if cuts[g] < cuts[g + 1]:
                    part = slice(cuts[g], cuts[g + 1])
                    for name, value in zip(out, (g, kind, packed_codes(codes[part]), packed_counts(counts[part])), strict=True):
                        out[name].append(value)
        give_back()
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
        return pa.table([arrays[0], pa.array([own] * len(out["group"]), pa.int32()), *arrays[1:]], names=["group", "chunk", "kind", "codes", "counts"])

    def totals(table: pa.Table, kind: int):
        """Rows of a kind with their totals, with and without the held-out folds, and the numbers of a group."""
        part = table.filter(pc.equal(table.column("kind"), kind))
        chunk = part.column("chunk").to_numpy()
        lists = [unpacked_codes(x.as_py()) for x in part.column("codes")]
        if not lists:
            return chunk, [], [], [], np.zeros(0), np.zeros(0)
        counts = np.concatenate([unpacked_counts(x.as_py()) for x in part.column("counts")]).astype(np.float64)
        sizes = [len(x) for x in lists]
        held = np.repeat((chunk >= chunks) & (chunk < chunks + folds), sizes)
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        every = np.bincount(inverse, counts, len(distinct))
        main = every - np.bincount(inverse, counts * held, len(distinct))
        cuts = np.cumsum(sizes)[:-1]
        return chunk, np.split(every[inverse], cuts), np.split(main[inverse], cuts), sizes, every, main

    schema = "chunk int, group int, kind int, counts binary, tokens bigint, main bigint, seen bigint"

    def answer(number: tuple, table: pa.Table, fit: bool) -> pa.Table:
        out = []
        for kind in (0, 1):
            chunk, every, main, sizes, all_counts, main_counts = totals(table, kind)
            for i in range(len(sizes)):
                if fit and chunks <= chunk[i] < chunks + folds:
                    out.append((int(chunk[i]), kind, packed_counts(main[i]), 0, 0, 0))
                elif not fit:
                    out.append((int(chunk[i]), kind, packed_counts(every[i]), 0, 0, 0))
            if kind == 0:
                # Sums over the groups go to everyone: chunk -1.
                out.append((-1, 0, None, int(all_counts.sum()), int(main_counts.sum()), int((all_counts > 0).sum())))
        chunk, kind, counts, tokens, main, seen = zip(*out, strict=True)
        arrays = [pa.array(chunk, pa.int32()), pa.array([number[0].as_py()] * len(out), pa.int32()), pa.array(kind, pa.int32()), pa.array(counts, pa.binary())]
        arrays += [pa.array(x, pa.int64()) for x in (tokens, main, seen)]
        del out
        give_back()
        return pa.table(arrays, names=["chunk", "group", "kind", "counts", "tokens", "main", "seen"])

    def tables(grams: Grams, right: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """The chunk's own codes with the returned counts."""
        out = []
        for kind, (codes, _) in enumerate(grams.distinct()):
            part = right.filter(pc.and_(pc.equal(right.column("kind"), kind), pc.is_valid(right.column("counts"))))
            part = part.sort_by([("group", "ascending")])
            lists = [unpacked_counts(x.as_py()) for x in part.column("counts")]
            out.append((codes, np.concatenate(lists) if lists else np.zeros(len(codes))))
        return out

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """Tokens per cell of a held-out chunk; from chunk -1 the sums over the groups."""
        if not left.num_rows:
            sums = [sum(x or 0 for x in right.column(c).to_pylist()) for c in ("tokens", "main", "seen")]
            return pa.table({"cell": ["tokens", "main", "seen"], "n": pa.array(sums, pa.int64())})
        grams = Grams(as_bytes(left.column(text).combine_chunks()), order, bits)
        counts, contexts = grams.found(tables(grams, right))
        logs = [counts[0], *estimates(counts, contexts, 1)[1:]]
        columns = [bucket_of(contexts[-1] if contexts else np.zeros(len(counts[0])))]
        columns += [np.where(x > 0, np.round(np.log(np.maximum(x, 1e-300)) / CELL), 10_000).astype(np.int64) for x in logs]
        kinds, many = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        cells = [",".join("z" if x == 10_000 else str(x) for x in row) for row in kinds.tolist()]
        del grams, counts, contexts, logs, columns
        give_back()
        return pa.table({"cell": pa.array(cells, pa.string()), "n": pa.array(many, pa.int64())})

    @F.arrow_udf("binary")
    def fitted(names: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for cells, many in zip(names.to_pylist(), numbers.to_pylist(), strict=True):
            found = Counter(dict(zip(cells, many, strict=True)))
            n, main, seen = (found.pop(x, 0) for x in ("tokens", "main", "seen"))
            out.append(json.dumps({"tokens": n, "seen": seen, "weights": learn(found, main, seen, order)}).encode())
        return pa.array(out, pa.binary())

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    out_schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns([chunk_name])
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in left.schema] + [pa.array([], t) for t in arrow], names=[*left.column_names, *names])
        model = json.loads(right.filter(pc.equal(right.column("kind"), -1)).column("counts")[0].as_py())
        n, seen = model["tokens"], model["seen"]
        grams = Grams(as_bytes(left.column(text).combine_chunks()), order, bits)
        counts, contexts = grams.found(tables(grams, right))
        weights = _weight_table(model["weights"], order)
        bucket = bucket_of(contexts[-1] if contexts else np.zeros(len(counts[0])))
        p = weights[bucket, 0] / (seen + 1)
        for k, estimate in enumerate(estimates(counts, contexts, n)):
            p += weights[bucket, k + 1] * estimate
        size = len(grams.sizes)
        base = np.bincount(grams.doc, np.log10((counts[0] + 1) / (n + seen + 1)), size)
        total = np.bincount(grams.doc, np.log10(p), size)
        known = np.bincount(grams.doc, counts[0] > 0, size).astype(np.int64)
        arrays = [pa.array(x, t) for x, t in zip((grams.sizes, known, np.full(size, n), base, total), arrow, strict=True)]
        for name, array in zip(names, arrays, strict=True):
            left = left.append_column(name, array)
        del grams, counts, contexts, bucket, p
        give_back()
        return left

    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    asked = dealt.groupBy(chunk_name).applyInArrow(ask, "group int, chunk int, kind int, codes binary, counts binary")
    fit = asked.groupBy("group").applyInArrow(lambda number, table: answer(number, table, True), schema)
    held = marked.where((F.col(chunk_name) >= chunks) & (F.col(chunk_name) < chunks + folds)).select(F.col(text), F.col(chunk_name))
    cells = held.groupBy(chunk_name).cogroup(fit.groupBy("chunk")).applyInArrow(tell, "cell string, n bigint")
    summed = cells.groupBy("cell").agg(F.sum("n").alias("n"))
    one = summed.agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("c")).select(fitted("c.cell", "c.n").alias("counts"))
    # The fitted model, a few kilobytes, goes to every chunk.
    everyone = F.explode(F.sequence(F.lit(0), F.lit(chunks + folds + tests - 1))).alias("chunk")
    model = one.select(everyone, F.lit(0).alias("group"), F.lit(-1).alias("kind"), "counts")
    answers = asked.groupBy("group").applyInArrow(lambda number, table: answer(number, table, False), schema)
    right = answers.where("chunk >= 0").select("chunk", "group", "kind", "counts").unionByName(model)
    return dealt.groupBy(chunk_name).cogroup(right.groupBy("chunk")).applyInArrow(score, out_schema)
