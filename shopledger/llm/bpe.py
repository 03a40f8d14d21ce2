"""BPE encoding by a prefix-sharing trie, and decoding.

Byte-pair encoding has a prefix property: the encoding of a word without its last token is the encoding
of that shorter prefix. So the encoding of every prefix of a word is fixed by one number, its last token.
Distinct words go into a trie of their bytes; walking it depth first, each node gets the last token of its
prefix: the one vocabulary entry that ends there and fits behind the last token of the prefix before it.
A prefix that many words share is computed once, and a word is read off by following last tokens back.
Sorted distinct words are such a trie in depth-first order: a node is a run of words that share a prefix, and
what the first word of the run gets, the others take over. The trie is walked level by level, all nodes of a
level at once as arrays; only tokens' pairs that were never met before are looked at one at a time.

Two tokens fit next to each other if, in the course of the merges, no merge crosses their border: along the
right edge of the first and the left edge of the second, each part exists from its own merge until it is
merged further, and a crossing merge needs two parts that exist at the same time.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import FACTOR, by_slices, give_back, unused

STEP_BYTES = 4 << 20  # text that is split and looked up at a time
STEP_PIECES = 20_000  # distinct pieces that are encoded at a time
LONG = 48  # longer pieces are encoded one by one
IDS = 1_000_000  # ids that one step of decoding takes
END = "</w>"
# Words that need the library's own normaliser: letters beyond U+02FF, spaces beyond ASCII, special tokens.
_ODD = r"[^\x00-\x{2FF}]|[\x{85}\x{A0}\x{130}]|<\|"
# The split of the vocabulary file, for the other words.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"
_EMPTY = np.uint64(0)


class _Table:
    """Open-addressed table from 64-bit keys (not 0) to numbers, looked up for whole arrays."""

    def __init__(self, bits: int):
        self.shift, self.size, self.used = np.uint64(64 - bits), 1 << bits, 0
        self.keys, self.values = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        for slot, key, value in zip(self._slots(keys).tolist(), keys.tolist(), values.tolist(), strict=True):
            while self.keys[slot] and self.keys[slot] != key:
                slot = (slot + 1) % self.size
            self.used += not self.keys[slot]
            self.keys[slot], self.values[slot] = key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slots = self._slots(keys)
        found = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slots[left]]
            hit = there == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (there != _EMPTY)]
            slots[left] = (slots[left] + 1) % self.size
        return found


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder for one vocabulary file; keeps its trie and its words between batches, both bounded."""

    def __init__(self, file: str):
        self._file = file
        spec = json.loads(file)
        model, letters = spec["model"], _byte_letters()
        self._letters = letters
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names: list[str | None] = [None] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.made, self.parts, self.joined = [-1] * size, [(-1, -1)] * size, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[a + b]
            self.made[token], self.parts[token] = rank, (vocab[a], vocab[b])
            self.joined[vocab[a] << 32 | vocab[b]] = token
        self._pairs = _Table(20)
        whole = self._whole_tokens()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, i in vocab.items():
            if i in whole:
                last = name.endswith(END)
                spelled = bytes(letters[c] for c in (name[: -len(END)] if last else name))
                (self.final if last else self.inner)[spelled] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        # Substrings are looked up by a rolling hash; its byte codes are fixed.
        rng = np.random.default_rng(5)
        self._codes = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers = np.cumprod(np.array([1] + [FACTOR] * LONG, np.uint64), dtype=np.uint64)
        self._tokens = _Table(18)
        for table, last in ((self.inner, 0), (self.final, 1)):
            short = {t: i for t, i in table.items() if len(t) <= LONG}
            keys = np.array([self._hash(t) for t in short], np.uint64) + self._ends[last]
            self._tokens.add(keys, np.array(list(short.values())))

    _ends = np.array([0, 0xD6E8FEB86659FD93], np.uint64)  # added to the hash of what ends a word

    def _hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * FACTOR + int(self._codes[b])) % (1 << 64)
        return h

    def _first_crossing(self, a: int, b: int) -> int | None:
        """Rank of the first merge over the border of tokens a and b, None if there is none."""
        best = None
        left, left_until = a, len(self.made)
        while left >= 0:
            right, right_until = b, len(self.made)
            while right >= 0:
                token = self.joined.get(left << 32 | right)
                if token is not None:
                    rank = self.made[token]
                    # Of equal merges the leftmost comes first, hence the one-sided equality.
                    if rank < left_until and rank <= right_until and (best is None or rank < best):
                        best = rank
                right, right_until = self.parts[right][0], self.made[right]
            left, left_until = self.parts[left][1], self.made[left]
        return best

    def _whole_tokens(self) -> set[int]:
        """Tokens that the encoding of their own letters yields."""
        whole = {i for i, rank in enumerate(self.made) if rank < 0}
        for i in sorted((i for i, rank in enumerate(self.made) if rank >= 0), key=self.made.__getitem__):
            a, b = self.parts[i]
            if a in whole and b in whole and self._first_crossing(a, b) == self.made[i]:
                whole.add(i)
        return whole

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens can stand next to each other in an encoding."""
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        got = self._pairs.find(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            if self._pairs.used + len(new) > self._pairs.size // 2:
                self._pairs = _Table(20)
            fit = [self._first_crossing(k - 1 >> 32, k - 1 & 0xFFFFFFFF) is None for k in new.tolist()]
            self._pairs.add(new, np.array(fit, np.int32))
            got = np.where(got < 0, self._pairs.find(keys), got)
            return np.where(got < 0, np.array(fit)[np.minimum(np.searchsorted(new, keys), len(new) - 1)], got) > 0
        return got > 0

    def _last_tokens(self, sums: np.ndarray, last: np.ndarray, begun: np.ndarray, rows: np.ndarray, end: int, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token of the prefix of length ``end`` of each of ``rows``, and where it begins.

        One entry only can be the last token, so the likely places come first: where the last token of the
        prefix before began, then later ones, then earlier ones.
        """
        token, start = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int32)
        left, likely, whole = np.arange(len(rows)), begun[rows, end - 1], sums[rows, end] + self._ends[final]
        for k in range(end):
            at = likely[left]
            at = np.where(k < end - at, at + k, end - 1 - k)
            keys = whole[left] - sums[rows[left], at] * self._powers[end - at]
            found = self._tokens.find(keys)
            hit = np.nonzero(found >= 0)[0]
            inside = at[hit] > 0
            good = ~inside
            good[inside] = self.fits(last[rows[left[hit[inside]]], at[hit[inside]]], found[hit[inside]])
            hit = hit[good]
            token[left[hit]], start[left[hit]] = found[hit], at[hit]
            left = left[token[left] < 0]
            if not len(left):
                return token, start
        raise ValueError(f"no token ends at byte {end}")

    def _encode_level_by_level(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and their number, of sorted distinct pieces of ``LONG`` bytes at most."""
        n, longest = len(size), int(size.max())
        column = np.arange(longest)
        inside = column < size[:, None]
        letters = np.where(inside, data[np.minimum(begin[:, None] + column, len(data) - 1)], 0)
        sums = np.zeros((n, longest + 1), np.uint64)
        for k in range(longest):
            sums[:, k + 1] = sums[:, k] * np.uint64(FACTOR) + self._codes[letters[:, k]]
        # Letters shared with the piece before, down to a node that is inside of both.
        shared = np.zeros(n, np.int64)
        same = (letters[1:] == letters[:-1]) & inside[1:] & inside[:-1]
        shared[1:] = np.minimum(np.cumprod(same, 1).sum(1), size[:-1] - 1)
        last, begun = np.zeros((n, longest + 1), np.int32), np.zeros((n, longest + 1), np.int32)
        for end in range(1, longest + 1):
            deeper = np.nonzero(size > end)[0]
            new = shared[deeper] < end
            nodes, closing = deeper[new], np.nonzero(size == end)[0]
            rows = np.concatenate([nodes, closing])
            final = np.repeat([0, 1], [len(nodes), len(closing)])
            token, start = self._last_tokens(sums, last, begun, rows, end, final)
            run = np.cumsum(new) - 1
            last[deeper, end], begun[deeper, end] = token[run], start[run]
            last[closing, end], begun[closing, end] = token[len(nodes) :], start[len(nodes) :]
        ids, at, row, count = [], size.astype(np.int32), np.arange(n), np.zeros(n, np.int64)
        while len(row):
            ids.append((row, last[row, at]))
            count[row] += 1
            at = begun[row, at]
            row, at = row[at > 0], at[at > 0]
        # Tokens were read from the end; the k-th from the end goes to that place.
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if n else 0, np.uint32)
        for k, (row, token) in enumerate(ids):
            out[ends[row] - 1 - k] = token
        return out, count

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, prefix by prefix."""
        last, begun = [-1], [0]
        for end in range(1, len(piece) + 1):
            table = self.final if end == len(piece) else self.inner
            for start in range(max(0, end - self.longest), end):
                token = table.get(piece[start:end])
                if token is not None and (not start or self.fits(np.array([last[start]]), np.array([token]))[0]):
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
            last.append(token)
            begun.append(start)
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at = begun[at]
        return ids[::-1]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and their number, of distinct pieces that the pre-tokeniser made; an empty piece has none."""
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.array_sort_indices(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        order = order[(size[order] > 0) & (size[order] <= LONG)]
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        runs, count = [], np.zeros(len(pieces), np.int64)
        for at in range(0, len(order), STEP_PIECES):
            run = order[at : at + STEP_PIECES]
            ids, count[run] = self._encode_level_by_level(data, offsets[run], size[run])
            runs.append(ids)
        for i in np.nonzero(size > LONG)[0]:
            ids = self.encode_piece(data[offsets[i] : offsets[i + 1]].tobytes())
            order, count[i] = np.append(order, i), len(ids)
            runs.append(np.array(ids, np.uint32))
        flat, place = _joined(runs), np.zeros(len(pieces), np.int64)
        place[order] = np.cumsum(count[order]) - count[order]
        return _gathered(flat, place, count, np.arange(len(pieces))), count

    def encode_odd(self, word: str) -> list[int]:
        """Ids of a word by the library's normaliser and split; special tokens as such."""
        out: list[int] = []
        for part in self.split_special.split(word) if self.split_special else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
                    out += self.encode_piece(bytes(self._letters[c] for c in piece))
        return out

    def _by_split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and their number, of lower-cased words that the pattern splits."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(words, _PIECE, "\\1 "))
        parts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        flat, count = self.encode_pieces(pieces.dictionary.cast(pa.large_binary()))
        own = pieces.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], count[own]]))[np.cumsum(np.concatenate([[0], parts]))]
        return _gathered(flat, np.cumsum(count) - count, count, own), np.diff(ends)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and their number, of distinct runs without ASCII spaces."""
        odd = pc.match_substring_regex(words, _ODD)
        lower = pc.utf8_lower(pc.if_else(odd, "", words)).cast(pa.large_string())
        # Most words are letters, with one mark at the end or none: their split is plain.
        other, mark = _marks(lower)
        single, double = other == 0, (other == 1) & mark
        stem = pc.utf8_slice_codeunits(lower.filter(pa.array(double)), 0, -1)
        tail = pc.utf8_slice_codeunits(lower.filter(pa.array(double)), -1)
        pieces = pa.concat_arrays([lower.filter(pa.array(single)), stem, tail, pa.array([""], pa.large_string())]).dictionary_encode()
        flat, count = self.encode_pieces(pieces.dictionary.cast(pa.large_binary()))
        own = pieces.indices.to_numpy(zero_copy_only=False)
        n, m = int(single.sum()), int(double.sum())
        two = np.stack([own[: n + m], np.concatenate([np.full(n, own[-1]), own[n + m : n + 2 * m]])], 1)
        runs = [_gathered(flat, np.cumsum(count) - count, count, two.ravel())]
        sizes = np.zeros(len(words), np.int64)
        order = [np.nonzero(single)[0], np.nonzero(double)[0]]
        sizes[np.concatenate(order)] = count[two].sum(1)
        rest = np.nonzero(~single & ~double)[0]
        more, sizes[rest] = self._by_split(lower.take(pa.array(rest)))
        runs.append(more)
        order.append(rest)
        odd = np.nonzero(odd.to_numpy(zero_copy_only=False))[0]
        order = np.concatenate(order)
        order = order[~np.isin(order, odd)]  # words left empty above
        for i in odd:
            ids = self.encode_odd(words[int(i)].as_py())
            runs.append(np.array(ids, np.uint32))
            sizes[i] = len(ids)
        order = np.concatenate([order, odd])
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gathered(_joined(runs), begin, sizes, np.arange(len(words))), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one more for the end). A null has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        tokens = lists.flatten().dictionary_encode()
        del lists
        flat, sizes = self.encode_words(tokens.dictionary)
        own = tokens.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], sizes[own]]))
        return _gathered(flat, np.cumsum(sizes) - sizes, sizes, own), ends[offsets]

    @functools.cached_property
    def library(self):
        """The tokenizers library's own reading of the file, made when a text needs its normaliser."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._file)

    @functools.cached_property
    def name_column(self) -> pa.Array:
        return pa.array(self.names, pa.string())


# Bytes of letters: ASCII ones and the two of U+00C0 to U+00FF; the marks of that range are left to the pattern.
_LETTERS = np.array([b in range(65, 91) or b in range(97, 123) or b in range(0x80, 0xC0) or b == 0xC3 for b in range(256)])


def _marks(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of each word are no letters, and whether the last one is an ASCII mark."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    other = ~_LETTERS[data]
    after = np.nonzero(data[:-1] == 0xC3)[0] + 1
    other[after[(data[after] == 0x97) | (data[after] == 0xB7)]] = True
    # A continuation byte counts as a letter after 0xC3 only; other lead bytes are no letters themselves.
    before = np.concatenate([[0], np.cumsum(other)])
    count = before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]
    full = offsets[1:] > offsets[:-1]
    last = np.zeros(len(words), np.uint8)
    last[full] = data[offsets[1:][full] - offsets[0] - 1]
    digit = (last >= 48) & (last <= 57)
    return count, (last < 128) & ~_LETTERS[last] & ~digit


def _joined(runs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(runs) if runs else np.zeros(0, np.uint32)


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that begin and size give, for each index in ``own``, in a row."""
    sizes = size[own]
    shift = begin[own] - np.cumsum(sizes) + sizes
    places = np.repeat(shift.astype(np.int32), sizes)
    places += np.arange(len(places), dtype=np.int32)
    return flat[places]


_models: dict[int, TrieBpe] = {}


class Vocabulary:
    """A tokeniser file on its way to the executors (a broadcast of the file, whose size is fixed)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self._file = spark.sparkContext.broadcast(file.read())

    def model(self) -> TrieBpe:
        key = hash(self._file.value)
        if key not in _models:
            _models.clear()
            _models[key] = TrieBpe(self._file.value)
        return _models[key]

    def __getstate__(self):
        return {"_file": self._file}


def _ids(model: TrieBpe, column: pa.Array) -> pa.Array:
    def work(part: pa.Array) -> pa.Array:
        found, starts = model.encode(part)
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(found.astype(np.int32)))

    return by_slices(column, work, pa.list_(pa.int32()), STEP_BYTES)


def _texts(model: TrieBpe, column: pa.Array) -> pa.Array:
    names, out, at = model.name_column, [], 0
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS, side="right")))
        flat, sizes = column.slice(at, stop - at).flatten(), lengths[at:stop]
        at = stop
        values = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        known = (values >= 0) & (values < len(names))
        taken = names.take(pa.array(np.where(known, values, 0)))
        if not known.all() or taken.null_count:
            keep = known & ~taken.is_null().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            taken, sizes = taken.filter(pa.array(keep)), np.bincount(row, minlength=len(sizes))
        bounds = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        out.append(pc.binary_join(pa.ListArray.from_arrays(bounds, taken), " "))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def encoded(vocabulary: Vocabulary, text: Column) -> Column:
    """Token ids of a text as array<int>; a null or an empty text has none."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return _ids(vocabulary.model(), column)

    return ids(text)


def decoded(vocabulary: Vocabulary, ids: Column) -> Column:
    """Text of token ids: their vocabulary entries with one space between; unknown ids and nulls are left out."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return _texts(vocabulary.model(), column)

    return texts(ids)


def with_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``docs`` with the columns ``ids`` (token ids) and ``back`` (the text they decode to).

    One pass without a shuffle; the work grows with the text, memory with the largest text of a batch.
    A null text counts as empty and has no ids; repeated rows give equal results; other columns stay,
    columns named like the new ones are replaced; an empty table stays empty.
    """

    @F.arrow_udf("struct<ids:array<int>,texts:string>")
    def both(column: pa.Array) -> pa.Array:
        # Ids are decoded where they were made, so that they cross to Python and back once.
        model = vocabulary.model()
        found = _ids(model, column)
        arrays = [found, _texts(model, found)]
        give_back()
        return pa.StructArray.from_arrays(arrays, names=["ids", "texts"])

    (name,) = unused(docs, "__tokens")
    rows = docs.withColumn(name, both(F.col(text)))
    return rows.withColumns({ids: F.col(f"{name}.ids"), back: F.col(f"{name}.texts")}).drop(name)
