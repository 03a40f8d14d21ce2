"""Text quality by a generalised additive model with pairwise interactions.

The score of a text is a sum of table entries: each feature value falls into a bin and each table gives a
number per bin; a few tables have two features. The tables are learned by cyclic boosting: round after round,
each feature in turn gets a shallow tree on the gradient of the log loss, which is added, shrunk, to its
table. Pairs are chosen by how much of the remaining gradient a small grid over both features explains.
Scoring is a search for bins and a sum of lookups, for whole batches at once.

A model is fitted on at most ``FIT_ROWS`` labelled rows (a fixed hash order chooses them); all rows are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, by_slices, words

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
FEATURES = (
    "bytes", "words", "word_bytes", "word_spread", "longest_word", "distinct", "distinct_by_size", "top_word",
    "same_as_before", "upper", "digits", "stops", "marks", "symbols", "pipes", "shouts", "beyond_ascii",
    "lines", "repeated_lines", "word_ends", "controls", "letters_by_word",
)
_STOPS, _MARKS = b".,;:?", b"\"'()-"
_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        65 <= _b <= 90,
        48 <= _b <= 57,
        _b in _STOPS,
        _b in _MARKS,
        33 <= _b <= 126 and not _c.isalnum() and _b not in _STOPS + _MARKS + b"!|",
        _b >= 128,
        _b < 32 and _b not in b"\t\n\r",
        _c.isalpha() and _b < 128 or _b >= 128,
    )
_SYMBOL_END = re.compile(rb"[^\w\s.,;:?!\"')\x80-\xff-](?=\s|\Z)")


def features(text: bytes) -> list[float]:
    """One number for each name in FEATURES; a text without words has zeros mostly."""
    tokens = words(text)
    size, n = max(1, len(text)), max(1, len(tokens))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, stops, marks, symbols, beyond, controls, letters = (counts @ _CLASS) / size
    tally = Counter(tokens)
    lengths = np.fromiter(map(len, tokens), np.float64, len(tokens)) if tokens else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x]
    repeated = sum(len(x) * (k - 1) for x, k in Counter(lines).items()) / size if len(lines) > 1 else 0.0
    same = sum(map(bytes.__eq__, tokens, tokens[1:])) / n
    return [
        np.log1p(len(text)), np.log1p(len(tokens)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(tally) / n,
        np.log(max(1, len(tally))) / np.log(n + 1), max(tally.values(), default=0) / n, same, upper, digits, stops, marks, symbols,
        counts[124] / size, counts[33] / size, beyond, len(lines) / n, repeated, len(_SYMBOL_END.findall(text)) / n, controls, letters * size / n,
    ]


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where to cut a run of bins in two so that the squared gradient explained is largest; 0 for nowhere."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > _gain(g.sum(), h.sum()) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, by bin, of a tree of ``depth`` cuts in a row over ordered bins."""
    at = _cut(g, h) if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a two-way tree: one feature is cut once, then the other within each side; the better order."""
    best, most = None, -1.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        at = _cut(a.sum(1), b.sum(1))
        out = np.empty_like(a)
        for rows in (slice(0, at), slice(at, None)) if at else (slice(None),):
            out[rows] = _tree(a[rows].sum(0), b[rows].sum(0), 1)
        gain = float((out * a).sum())
        if gain > most:
            best, most = out.T if turned else out, gain
    return best


@dataclass
class QualityModel:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by row of feature values; 0.5 from a model that saw no labels."""
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            total += table[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return _sigmoid(total)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equally many rows; a value that many rows share is alone in its bin."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def learn(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Cyclic boosting of tables for each feature, then of the most useful pairs."""
    if not len(y):
        return QualityModel()
    model = QualityModel(_logit(np.clip(y.mean(), 0.01, 0.99)), [_cuts(x[:, j], BINS) for j in range(x.shape[1])])
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, own in enumerate(bins):
            p = _sigmoid(total)
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(own, y - p, n), np.bincount(own, p * (1 - p), n))
            model.tables[j] += step
            total += step[own]
    small = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    own = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(small)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(small[a]) + 1, len(small[b]) + 1)
        return np.bincount(own[a] * shape[1] + own[b], values, shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(total)
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            g, h = grid(a, b, y - p), grid(a, b, p * (1 - p))
            gains.append((float((_grid_tree(g, h) * g).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    tables = {two: np.zeros((len(small[two[0]]) + 1, len(small[two[1]]) + 1)) for two in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            p = _sigmoid(total)
            step = RATE * _grid_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))
            tables[a, b] += step
            total += step[own[a], own[b]]
    model.pairs = [(a, b, small[a], small[b], tables[a, b]) for a, b in chosen]
    return model


def feature_column(text: Column) -> Column:
    """Feature values of a text as array<double>; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def values(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.float64())
        return by_slices(column, lambda part: pa.array([features(t) for t in as_bytes(part)], kind), kind)

    return values(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> QualityModel:
    """Model of the labelled texts; at most ``rows`` of them are learned from, which bounds broadcast and driver.

    Labels, then labelled texts, are taken in a fixed hash order. Equal labelled texts of one key count once; a key
    with different texts or labels counts with each of them.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y")).dropna().distinct()
    taken = known.orderBy(F.xxhash64("_key"), "_key", "_y").limit(rows)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("_h"))
    met = texts.join(F.broadcast(taken), "_key")
    # A key may have very many rows: what is learned from is chosen by key and digest, which are combined before they are shuffled.
    names = ["_key", "_y", "_h"]
    chosen = met.select(*names).distinct().orderBy(F.xxhash64("_key", "_h"), *names).limit(rows)
    found = met.join(F.broadcast(chosen), names).select(*names, feature_column(F.col("_t")).alias("x")).dropDuplicates(names)
    data = found.select("_key", "_y", "x").collect()
    data.sort(key=lambda r: (r["_key"], r["_y"], r["x"]))  # the model must not depend on the order of tasks
    return learn(np.array([r["x"] for r in data]).reshape(-1, len(FEATURES)), np.array([r["_y"] for r in data]))


def quality_score(model: QualityModel, text: Column) -> Column:
    """Probability (0 to 1) that a text is of label 1; empty and null texts are scored as texts of no words."""

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        def work(part: pa.Array) -> pa.Array:
            return pa.array(model.score(np.array([features(t) for t in as_bytes(part)])), pa.float64())

        return by_slices(column, work, pa.float64())

    return scores(text)


def with_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from the threshold on), one row each, in one pass without a shuffle.

    Null and empty texts are scored as texts of no words. Columns of these names are replaced; repeated rows get equal
    scores; an empty table stays empty.
    """
    rows = docs.withColumn("score", quality_score(model, F.col(text)))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
