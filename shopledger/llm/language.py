"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits. For each bit a binary n-gram classifier (log odds of the n-grams of the
languages with the bit against those without) gives a margin, a mean over the n-grams of the text. Decoding
adds, for each codeword, a loss of every margin that disagrees with it, weighted by how well the bit separates
the languages it was learned from, and takes the codeword with the smallest loss. A text whose two nearest
codewords are about equally near is flagged as ambiguous.

N-grams fall into ``SLOTS`` hash slots, so a model is a small matrix whatever the corpus. Learning is one pass
over all labelled texts that adds up counts by language and slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import by_slices, unused

SLOTS = 1 << 13
SIZES = (2, 3)  # bytes of an n-gram
SMOOTHING = 0.5
AMBIGUOUS = 0.1  # share of the nearest loss by which the second one must be larger
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# Bytes that are no letter become spaces; bytes of multi-byte letters stay.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Slot counts of the n-grams of a lower-cased text."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" ", np.uint8)
    counts = np.zeros(SLOTS, np.int64)
    for size in SIZES:
        code = np.full(max(0, len(raw) - size + 1), size, np.uint32)
        for k in range(size):
            code = code * np.uint32(257) + raw[k : len(raw) - size + 1 + k]
        code *= np.uint32(2654435761)
        counts += np.bincount(code >> np.uint32(32 - 13), minlength=SLOTS)
    return counts


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords of n languages: every split of the languages if few, else well separated fixed ones."""
    if n <= 6:
        rows = [[1 if (column >> i) & 1 == 0 or i == 0 else -1 for column in range(1, 1 << (n - 1))] for i in range(n)]
        for i in range(1, n):
            rows[i] = [-1 if (column >> (i - 1)) & 1 else 1 for column in range(1, 1 << (n - 1))]
        rows[0] = [1] * ((1 << (n - 1)) - 1)
        return np.array(rows).reshape(n, -1)
    bits, best, apart = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(50):
        draw = np.random.default_rng(seed).choice((-1, 1), size=(n, bits))
        draw[0, (draw == draw[0]).all(0)] *= -1
        least = min((draw[a] != draw[b]).sum() for a, b in combinations(range(n), 2))
        if least > apart:
            best, apart = draw, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # slots x bits, scaled so that a typical margin is 1
    weight: np.ndarray  # bits

    def losses(self, text: str) -> np.ndarray:
        counts = profile(text)
        margins = (counts @ self.odds) / max(1, counts.sum())
        return (np.exp(-self.code * margins) * self.weight).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its share of exp(-loss) (0 to 1), and whether the two nearest codewords are about as near."""
        if not text or not self.languages or _LETTER.search(text) is None:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(text)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) / max(self.weight.mean(), 1e-9))
        near = loss[order[1]] - loss[order[0]] < AMBIGUOUS * loss[order[0]]
        return self.languages[order[0]], float(share[order[0]] / share.sum()), bool(near)


def learn(counts: dict[str, np.ndarray]) -> LanguageModel:
    """Model from slot counts by language."""
    languages = sorted(counts)
    if len(languages) < 2:
        return LanguageModel(languages, np.ones((len(languages), 0)), np.zeros((SLOTS, 0)), np.zeros(0))
    shares = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * SLOTS) for x in languages])
    code = codewords(len(languages))
    odds = np.empty((SLOTS, code.shape[1]))
    for b in range(code.shape[1]):
        odds[:, b] = np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0))
    typical = (shares @ odds) * code  # margin that the text of each language has on average
    scale = np.abs(typical).mean(0)
    return LanguageModel(languages, code, odds / scale, np.clip(typical.min(0) / scale, 0.05, None))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Model of all rows with a text and a language; what reaches the driver is a count by language and slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def flushed():
            if found:
                rows = [np.nonzero(c)[0] for c in found.values()]
                names = [x for x, r in zip(found, rows, strict=True) for _ in r]
                many = np.concatenate([c[r] for c, r in zip(found.values(), rows, strict=True)])
                slots = np.concatenate(rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(slots), pa.array(many)], ["lang", "slot", "n"])
                found.clear()

        for batch in batches:
            for t, x in zip(batch.column(0), batch.column(1), strict=True):
                name = x.as_py()
                found[name] = found.get(name, 0) + profile(t.as_py())
                if len(found) > 200:
                    yield from flushed()
        yield from flushed()

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("x")).where("t is not null and x is not null")
    parts = rows.mapInArrow(count, "lang string, slot int, n bigint")
    counts: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(SLOTS, np.int64))[r["slot"]] = r["n"]
    return learn(counts)


def predicted(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, ambiguous) of a text; ``und`` with score 0 if it is null or has no letter."""

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def found(column: pa.Array) -> pa.Array:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

        def work(part: pa.Array) -> pa.Array:
            names, scores, near = zip(*(model.predict(t) for t in part.to_pylist()), strict=True)
            arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(near, pa.bool_())]
            return pa.StructArray.from_arrays(arrays, fields=list(kind))

        return by_slices(column, work, kind)

    return found(text)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part`` on division by ``parts``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``, one row each; columns of these names are replaced.

    Null and empty texts, and texts without letters (Unicode category L), are ``und``. Of languages that are equally
    near, the first by name is taken and the row is ambiguous. Repeated rows get equal results. A model of no
    language says ``und`` throughout. An empty table stays empty. One pass without a shuffle; very long texts take time
    in proportion to their length.
    """
    (name,) = unused(docs, "__language")
    rows = docs.withColumn(name, predicted(model, F.col(text)))
    return rows.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop(name)
