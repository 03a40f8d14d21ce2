"""Repeated passages: prefix-partitioned suffix trees over words.

Every word position begins a suffix of its document. A passage repeats if two suffixes share their first
``WINDOW`` words, that is, if a node of the suffix tree at that depth has suffixes of several documents below
it. The tree is never built as a whole, and most suffixes never become a part of it:

* Suffixes are read only as far as they are needed. A first exchange tells which runs of ``WINDOW`` words occur in more than one
  slice of the documents at all: a slice sends each group of a hash space the short codes of its distinct runs, and
  gets back a bit for each. A few codes are shared by different runs; these drop out in the tree.
* Each suffix that is left goes to a tree by its path, the codes of its first 2, 4 and ``WINDOW`` words one after the other.
  Trees are ranges of the order of paths, that is of the depth-first order of the whole tree, with bounds
  drawn from a sample, so that a tree fits into memory: most hold many prefixes of two words, and where a prefix is
  frequent, bounds fall behind longer prefixes, down to single nodes.
* In a tree, the sorted paths list the suffixes depth first. Neighbours with an equal path are below one internal
  node at the depth of ``WINDOW`` words; its suffixes repeat those of a smaller key if the first slice that has the node holds smaller
  keys only. Consecutive suffixes of a document that do so make up a maximal repeat.
* Within its own slice a document compares with smaller keys directly, word by word.

A path has 128 bits: 44 of the prefixes, 20 of the run's code and 64 of a second code of other hashes of its words. So two
different runs share one with a probability of 2^-84 for each pair if their first four words are the same, and of 2^-128 if the
first two are not. Documents lie in slices by key, with about equal bytes. A slice sends a node once, however often it
occurs there, so a passage that very many documents share reaches a group or a tree once a slice. The
documents' own shuffle serves all three passes over the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import group_bounds, key_slices, packed_codes, packed_counts, parts_for, text_size, unpacked_codes, unpacked_counts
from .text import FACTOR, give_back, in_slices, mixed, unused

WINDOW = 13
PREFIXES = ((2, 24), (4, 20))  # words of a prefix, and bits of its code that lead a path
SPARE_BITS = 8  # bits of a short code beyond those that number the corpus' bytes
GROUP_CODES = 4_000_000  # short codes that a task of the first exchange holds, on average
TREE_SUFFIXES = 1_000_000  # suffixes of a tree, if half of all are left
SAMPLE_PATHS = 200_000  # paths that the bounds of trees are drawn from
SLICE_BYTES = 4 << 20  # text of a slice
_BACK = pow(FACTOR, -1, 1 << 64)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes (by sorting: far faster here than by a hash table)."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and how many each text has; only ASCII white space parts words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at the ends leaves empty words
    return flat.filter(full), np.bincount(parent.filter(full).to_numpy(), minlength=len(column)).astype(np.int64)


class Suffixes:
    """The words of a slice's documents, and a code of the run of ``window`` words at each place that has one."""

    def __init__(self, column: pa.Array, window: int):
        self.window = window
        flat, self.counts = tokens(column)
        self.ends = np.cumsum(self.counts)
        self.total = len(flat)
        named = flat.dictionary_encode()
        self.word = named.indices.to_numpy()
        known = map(xxhash.xxh64_intdigest, named.dictionary.cast(pa.binary()).to_pylist())
        self._hashes = np.fromiter(known, np.uint64, len(named.dictionary))
        runs = np.maximum(0, self.counts - window + 1)
        self.window_doc = np.repeat(np.arange(len(column), dtype=np.int32), runs)
        # Window i of a document begins i words after the document.
        place = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        self.starts = (np.repeat(self.ends - self.counts, runs) + place).astype(np.int32)
        # Sums of hash * FACTOR^-place: a run's code is a difference of two, moved back to its place.
        hashes = self._hashes[self.word] if self.total else np.zeros(0, np.uint64)
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(_BACK, self.total)[: self.total], dtype=np.uint64)])
        self._forth = _powers(FACTOR, self.total)
        self.codes = self.run_codes(self.starts, window)

    def run_codes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """64-bit codes of the runs of ``size`` words at ``starts``."""
        return mixed((self._sums[starts + size] - self._sums[starts]) * self._forth[starts] + np.uint64(size))

    def same_runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the runs at places ``a`` and ``b`` have the same words."""
        same = np.ones(len(a), bool)
        for n in range(self.window):
            same &= self.word[a + n] == self.word[b + n]
        return same

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """First window of each distinct run, in the order of codes, and the number of its run for each window."""
        _, first, node = np.unique(self.codes, return_index=True, return_inverse=True)
        again = np.flatnonzero(first[node] != np.arange(len(node)))
        wrong = again[~self.same_runs(self.starts[again], self.starts[first[node[again]]])]
        for w in wrong.tolist():  # different runs of one code: the second is a node of its own
            alike = [n for n in np.flatnonzero(self.codes[first] == self.codes[w]).tolist() if self.same_runs(self.starts[[w]], self.starts[[first[n]]])[0]]
            if not alike:
                first, alike = np.append(first, w), [len(first)]
            node[w] = alike[0]
        return first, node

    def paths(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path of the run at each window, as two numbers: prefix codes and the run's code, and a second code of the run."""
        starts = self.starts[windows]
        head, left = np.zeros(len(starts), np.uint64), 64
        for size, bits in PREFIXES:
            left -= bits
            head |= self.run_codes(starts, min(size, self.window)) >> np.uint64(64 - bits) << np.uint64(left)
        # The second code is made of other hashes of the words, so it tells runs apart that the first does not.
        other, run = mixed(self._hashes ^ np.uint64(FACTOR)), np.zeros(len(starts), np.uint64)
        for n in range(self.window):
            run = run * np.uint64(_BACK) + other[self.word[starts + n]]
        return head | self.codes[windows] >> np.uint64(64 - left), mixed(run)


def _in_key_order(table: pa.Table, key: str, text: str) -> pa.Table:
    """Nulls last; rows of one key by text, so that every pass over a slice sees the same order."""
    return table.sort_by([(key, "ascending"), (text, "ascending")])


def _ranks(keys: pa.ChunkedArray) -> np.ndarray:
    """Number of each row's key in key order; documents of one key, or of none, are not before each other."""
    values = keys.to_pylist()
    return np.cumsum([0, *(a != b for a, b in zip(values[1:], values, strict=False))]) if values else np.zeros(0, np.int64)


def _path_bounds(docs: DataFrame, text: str, size: int, trees: int, window: int) -> np.ndarray:
    """``trees`` - 1 first halves of paths that cut the suffixes into parts of about equal number, from a sample.

    The bounds steer where suffixes meet, never which of them are equal.
    """
    if trees < 2:
        return np.zeros(0, np.uint64)
    share = min(1.0, 2 * SAMPLE_PATHS / max(1, size / 6))  # of the suffixes: a sixteenth of those of the documents drawn
    of_docs = min(1.0, 16 * share)
    threshold = np.uint64(min((1 << 64) - 1, int(share / of_docs * 2**64)))

    def draw(batches):
        for batch in batches:
            for part in in_slices(batch.column(0)):
                own = Suffixes(part, window)
                # By a hash of the place, so that a passage counts as often as it occurs.
                picked = np.flatnonzero(mixed(own.codes ^ np.arange(len(own.codes), dtype=np.uint64)) <= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(own.paths(picked)[0].view(np.int64))], ["path"])

    drawn = docs.where(F.pmod(F.xxhash64(text, F.lit(5)), F.lit(1 << 20)) <= int(of_docs * (1 << 20))).select(F.col(text).alias("t"))
    rows = drawn.mapInArrow(draw, "path bigint").orderBy(F.xxhash64("path")).limit(SAMPLE_PATHS).collect()
    paths = np.sort(np.array([r["path"] for r in rows], np.int64).view(np.uint64))
    return paths[np.arange(1, trees) * len(paths) // trees] if len(paths) else np.zeros(trees - 1, np.uint64)


ADDED = ("n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space), or as ``added`` names them.

    A word goes if a run of ``window`` words that covers it also begins in a document of a smaller key; runs
    are judged on the input. Null texts have no words. Keys are whole numbers (``TypeError`` else); null keys count as larger
    than all others; rows of one key are not compared with each other. Columns of the new names are replaced. Texts are
    never cut; an empty table stays empty.
    """
    _, size = text_size(docs, text)
    slices = key_slices(docs, key, text, parts_for(docs, size, SLICE_BYTES))
    order = slices.order
    most = max(1, size // 6)  # suffixes, about
    groups = max(parts_for(docs, size, 1 << 62), -(-most // GROUP_CODES))
    trees = max(parts_for(docs, size, 1 << 62), -(-most // (2 * TREE_SUFFIXES)))
    bits = min(64, max(1, size).bit_length() + SPARE_BITS)
    drop = np.uint64(64 - bits)
    bounds = _path_bounds(docs, text, size, trees, window)
    rows = docs.drop(*added)
    (own_slice,) = unused(rows, "__slice")
    dealt = rows.withColumn(own_slice, slices.slice(F.col(key), F.col(text))).repartition(own_slice)

    def suffixes(table: pa.Table) -> Suffixes:
        return Suffixes(_in_key_order(table.select([key, text]), key, text).column(text).combine_chunks(), window)

    def ask(number: tuple, table: pa.Table) -> pa.Table:
        """The short codes of a slice's runs, by group."""
        codes = _distinct(suffixes(table).codes >> drop)
        cuts = group_bounds(codes, groups, bits)
        there = [g for g in range(groups) if cuts[g] < cuts[g + 1]]
        lists = [packed_codes(codes[cuts[g] : cuts[g + 1]]) for g in there]
        give_back()
        return pa.table(
            {"group": pa.array(there, pa.int32()), "slice": pa.array([number[0].as_py()] * len(there), pa.int32()), "codes": pa.array(lists, pa.binary())}
        )

    def answer(number: tuple, table: pa.Table) -> pa.Table:
        """For each slice's codes a bit: whether a slice of another order has the code too."""
        table = table.sort_by([("slice", "ascending")])
        lists = [unpacked_codes(x) for x in table.column("codes").to_pylist()]
        codes, own = np.concatenate(lists), np.repeat(order[table.column("slice").to_numpy()], [len(x) for x in lists])
        by = np.argsort(codes, kind="stable")  # slice by slice below a code
        codes, own = codes[by], own[by]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        many = np.diff(np.append(first, len(codes)))
        several = np.empty(len(by), bool)
        several[by] = np.repeat(own[first] != own[first + many - 1], many)
        seen = [np.packbits(x).tobytes() if x.any() else None for x in np.split(several, np.cumsum([len(x) for x in lists])[:-1])]
        kept = [i for i, s in enumerate(seen) if s is not None]
        give_back()
        return pa.table(
            {
                "slice": table.column("slice").take(pa.array(kept, pa.int64())).cast(pa.int32()),
                "group": pa.array([number[0].as_py()] * len(kept), pa.int32()),
                "seen": pa.array([seen[i] for i in kept], pa.binary()),
            }
        )

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """The paths of a slice's suffixes that may be below a node of several slices, by tree, with their windows."""
        out: dict[str, list] = {"tree": [], "slice": [], "heads": [], "tails": [], "windows": []}
        if left.num_rows and right.num_rows:
            own = suffixes(left)
            codes = _distinct(own.codes >> drop)
            cuts, several = group_bounds(codes, groups, bits), np.zeros(len(codes), bool)
            for g, seen in zip(right.column("group").to_pylist(), right.column("seen").to_pylist(), strict=True):
                a, b = cuts[g], cuts[g + 1]
                several[a:b] = np.unpackbits(np.frombuffer(seen, np.uint8), count=b - a)
            first, _ = own.nodes()
            windows = first[several[np.searchsorted(codes, own.codes[first] >> drop)]]
            head, tail = own.paths(windows)
            by = np.argsort(head, kind="stable")
            head, tail, windows = head[by], tail[by], windows[by]
            ends = [0, *np.searchsorted(head, bounds).tolist(), len(head)]
            for tree, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if a < b:
                    values = (tree, left.column(own_slice)[0].as_py(), packed_codes(head[a:b]), tail[a:b].tobytes(), packed_counts(windows[a:b]))
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
        give_back()
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def grow(number: tuple, table: pa.Table) -> pa.Table:
        """A tree: for each slice the windows below a node that a slice of a lower order has too."""
        heads = [unpacked_codes(x) for x in table.column("heads").to_pylist()]
        head, tail = np.concatenate(heads), np.frombuffer(b"".join(table.column("tails").to_pylist()), "<u8")
        own = np.repeat(order[table.column("slice").to_numpy()], [len(x) for x in heads])
        by = np.lexsort((own, tail, head))  # depth first; below a node the lowest order first
        head, tail, own = head[by], tail[by], own[by]
        first = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))
        repeat = np.empty(len(by), bool)
        repeat[by] = own > np.repeat(own[first], np.diff(np.append(first, len(own))))
        found = []
        for marks, windows in zip(np.split(repeat, np.cumsum([len(x) for x in heads])[:-1]), table.column("windows").to_pylist(), strict=True):
            found.append(packed_codes(np.sort(unpacked_counts(windows)[marks])) if marks.any() else None)
        kept = [i for i, x in enumerate(found) if x is not None]
        give_back()
        return pa.table({"slice": table.column("slice").take(pa.array(kept, pa.int64())).cast(pa.int32()), "windows": pa.array([found[i] for i in kept], pa.binary())})

    kinds = (T.LongType(), T.LongType(), T.StringType())
    kept_schema = T.StructType([*rows.schema.fields, *map(T.StructField, added, kinds)])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _in_key_order(left, key, text)
        column = left.column(text).combine_chunks()
        own = Suffixes(column, window)
        gone = _repeated_words(own, _ranks(left.column(key)), *own.nodes(), [unpacked_codes(x) for x in right.column("windows").to_pylist()])
        del own
        flat, counts = tokens(column)
        removed = np.bincount(np.repeat(np.arange(len(counts)), counts), gone, len(counts)).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts - removed)]), pa.int32())
        kept = pc.binary_join(pa.ListArray.from_arrays(ends, flat.filter(pa.array(~gone))), " ")
        table = left.drop_columns([own_slice])
        for name, array in zip(added, (pa.array(counts), pa.array(removed), kept.cast(pa.string())), strict=True):
            table = table.append_column(name, array)
        del flat, gone, kept
        give_back()
        return table

    by_slice = dealt.groupBy(own_slice)
    asked = by_slice.applyInArrow(ask, "group int, slice int, codes binary")
    answers = asked.groupBy("group").applyInArrow(answer, "slice int, group int, seen binary")
    sent = by_slice.cogroup(answers.groupBy("slice")).applyInArrow(send, "tree int, slice int, heads binary, tails binary, windows binary")
    grown = sent.groupBy("tree").applyInArrow(grow, "slice int, windows binary")
    return by_slice.cogroup(grown.groupBy("slice")).applyInArrow(remove, kept_schema)


def _repeated_words(own: Suffixes, rank: np.ndarray, first: np.ndarray, node: np.ndarray, elsewhere: list[np.ndarray]) -> np.ndarray:
    """Which words lie in a run that begins in a document of a smaller key, here or (first windows of ``elsewhere``) in another slice."""
    window_rank = rank[own.window_doc]
    first_rank = np.full(len(first), len(rank), np.int64)
    np.minimum.at(first_rank, node, window_rank)
    known = np.zeros(len(own.codes), bool)
    for windows in elsewhere:
        known[windows.astype(np.int64)] = True
    again = known[first][node] | (window_rank > first_rank[node])
    marks = np.zeros(own.total + 1, np.int64)
    np.add.at(marks, own.starts[again], 1)
    np.add.at(marks, own.starts[again] + own.window, -1)
    return np.cumsum(marks[:-1]) > 0


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a text that loses nothing stays as it is."""
    n_words, n_removed, kept = unused(docs, *ADDED)
    rows = without_repeats(docs, key, text, window, (n_words, n_removed, kept))
    changed = F.when(F.col(n_removed) > 0, F.col(kept)).otherwise(F.col(text))
    return rows.withColumn(text, changed).select(*docs.columns)
