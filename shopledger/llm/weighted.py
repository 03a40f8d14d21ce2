"""Document fingerprints by consistent weighted sampling, made of DataFrame expressions only.

The terms of a text are its words, weighted by how often they occur. For each of ``SAMPLES`` samples, hashes
of (sample, term) give every term its own r and c, both Gamma(2, 1), and b, uniform in (0, 1). With weight w
the term gets t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)); the sample is the term with
the least a, at its level t. Two texts choose the same sample with a probability equal to the generalised
Jaccard similarity of their weights, sum(min) / sum(max), so the share of equal samples estimates it.
Since a is a continuous function of (term, t), the least ln a stands for the pair.

Neighbours (the next document by descending key) come from slices of neighbouring keys: a slice is ordered in
one task, and a copy of the next slice's first text closes it. The texts are shuffled once, by slice; words,
weights and samples of a document never leave that partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import key_slices, parts_for, text_size

SAMPLES = 32
SLICE_BYTES = 4 << 20  # text whose terms one task counts at a time
_WORDS = r"[\x20\x09-\x0D]+"


def _bits(value: Column, first: int, n: int) -> Column:
    """Bits of a hash as a number strictly between 0 and 2^n."""
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)


def _log_a(sample: int, term: Column, log_weight: Column) -> Column:
    """ln a of a term in one sample: ln c - r (t - b) - r."""
    h = F.xxhash64(F.lit(sample), term)
    # Minus the log of a product of two uniform numbers of 12 bits is Gamma(2, 1).
    both = F.lit(24 * math.log(2))
    r = both - F.ln(_bits(h, 0, 12) * _bits(h, 12, 12))
    log_c = F.ln(both - F.ln(_bits(h, 24, 12) * _bits(h, 36, 12)))
    b = _bits(h, 48, 16) / F.lit(65536.0)
    return log_c - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (_slice, _pos, _real, ``key``, ``text``, _next) in descending order of the key, null keys first.

    ``_next`` is the text of the next document, after the last one that of the first; equal keys go by slice, then text.
    Rows that are not ``_real`` close a slice with the text that follows it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    _, size = text_size(rows, "_text")
    parts = parts_for(rows, size, SLICE_BYTES)
    slices = key_slices(rows, "_key", "_text", parts)
    placed = rows.withColumn("_slice", slices.slice(F.col("_key"), F.col("_text")))
    # One row for each slice reaches the driver: its first key in the order (null if it has null keys).
    first = placed.groupBy("_slice").agg(F.max("_key").alias("top"), F.max(F.col("_key").isNull()).alias("null")).collect()
    order = sorted((r["_slice"], None if r["null"] else r["top"]) for r in first)
    after = [(s, *order[i - 1]) for i, (s, _) in enumerate(order)]
    kind = docs.schema[key].dataType.simpleString()
    closing = spark.createDataFrame(after, f"_before int, _in int, _head {kind}")
    # As many rows as slices, whose number is bounded by the root of the size: some kilobytes.
    met = placed.join(F.broadcast(closing), (F.col("_slice") == F.col("_in")) & F.col("_key").eqNullSafe(F.col("_head")))
    heads = met.groupBy(F.col("_before").alias("_slice")).agg(F.min("_text").alias("_text"))
    real = placed.select("_slice", F.lit(True).alias("_real"), "_key", "_text")
    closed = real.unionByName(heads.select("_slice", F.lit(False).alias("_real"), F.lit(None).cast(kind).alias("_key"), "_text"))
    down = Window.partitionBy("_slice").orderBy(F.col("_real").desc(), F.col("_key").desc_nulls_first(), "_text")
    # More partitions than slices, so that few partitions get several of them.
    dealt = closed.repartition(3 * parts, "_slice")
    return dealt.select("_slice", "_real", "_key", "_text", F.row_number().over(down).alias("_pos"), F.lead("_text").over(down).alias("_next"))


def _sampled(texts: DataFrame, samples: int) -> DataFrame:
    """Least ln a by sample (arrays ``own`` and ``other``) of the columns ``_text`` and ``_edited`` of each (_slice, _pos)."""
    both = texts.select(
        "_slice", "_pos", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("of"), F.col("_edited").alias("t")))).alias("x")
    )
    # A text without words leaves one empty word, which keeps its row and has no samples.
    found = both.where("x.t is not null").select("_slice", "_pos", "x.of", F.explode(F.split("x.t", _WORDS)).alias("w"))
    terms = found.select("_slice", "_pos", "of", F.when(F.col("w") != "", F.xxhash64("w")).alias("term"))
    counts = terms.groupBy("_slice", "_pos", "term").agg(F.sum(1 - F.col("of")).alias("n"), F.sum("of").alias("m"))
    # Where both texts have a term equally often, its samples are made once for both (use 2).
    uses = F.when(F.col("n") == F.col("m"), F.array(F.struct(F.lit(2).alias("use"), F.col("n").alias("w")))).otherwise(
        F.array(F.struct(F.lit(0).alias("use"), F.col("n").alias("w")), F.struct(F.lit(1).alias("use"), F.col("m").alias("w")))
    )
    weighted = counts.select("_slice", "_pos", "term", F.explode(uses).alias("u")).where("u.w > 0")
    log_weight = F.when(F.col("term").isNotNull(), F.ln("u.w"))
    weighted = weighted.select("_slice", "_pos", "u.use", "term", log_weight.alias("lw"))
    least = weighted.groupBy("_slice", "_pos", "use").agg(*(F.min(_log_a(k, F.col("term"), F.col("lw"))).alias(f"s{k}") for k in range(samples)))

    def of(use: int) -> list[Column]:
        return [F.min(F.when(F.col("use") != 1 - use, F.col(f"s{k}"))).alias(f"{'ab'[use]}{k}") for k in range(samples)]

    merged = least.groupBy("_slice", "_pos").agg(*of(0), *of(1))
    arrays = [F.array(*(f"{x}{k}" for k in range(samples))).alias(name) for x, name in (("a", "own"), ("b", "other"))]
    return merged.select("_slice", "_pos", *arrays)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two signatures; texts without words are like each other."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def as_text(signature: Column, samples: int = SAMPLES) -> Column:
    """Signature as hex digits, eight for each sample; a text without words has zeros."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(F.coalesce(F.xxhash64(x), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    empty = F.lit("00000000" * samples)
    return F.when(signature[0].isNull(), empty).otherwise(F.lower(F.array_join(digits, "")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, edited_as: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Fingerprints of each text and of its edited version, and how like they are.

    Edited: the last third (floor(n_chars / 3) code points) is replaced by as many first code points of the
    next document by descending key (or all it has). Returns ``key``, ``n_chars``, ``edited`` (the text, or what
    ``edited_as`` makes of it before rows are joined, such as a digest), ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` (likeness of the signatures of text and edited
    text, of text and next text). Equal texts have equal fingerprints. A null text counts as empty; keys are whole
    numbers (``TypeError`` else); null keys are first in the order; rows of one key follow each other, in slices of their
    own where they are more than one holds; a single document is its own next one; an empty table
    gives an empty one. Other columns are not carried.
    """
    rows = neighbours(docs, key, text)
    n = F.char_length("_text")
    third = F.floor(n / 3).cast("int")
    cut = F.concat(F.expr("substring(_text, 1, char_length(_text) - cast(floor(char_length(_text) / 3) as int))"), F.substring("_next", F.lit(1), third))
    edited = rows.select("_slice", "_pos", "_real", "_key", "_text", F.when(F.col("_real"), cut).alias("_edited"))
    down = Window.partitionBy("_slice").orderBy("_pos")
    sampled = _sampled(edited, samples).withColumn("next", F.lead("own").over(down))
    near = sampled.select(
        "_slice",
        "_pos",
        as_text(F.col("own"), samples).alias("fingerprint"),
        as_text(F.col("other"), samples).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    )
    meta = edited.where("_real").select("_slice", "_pos", F.col("_key").alias(key), F.char_length("_text").cast("long").alias("n_chars"), edited_as(F.col("_edited")).alias("edited"))
    return meta.join(near, ["_slice", "_pos"]).select(key, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
