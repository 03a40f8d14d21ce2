"""Cutting a table into slices of neighbouring keys, and sorted code lists as compact binary values."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 8 << 20  # text of one slice


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return row[0], row[1]


def parts_for(df: DataFrame, size: int, part_bytes: int = SLICE_BYTES) -> int:
    """Parts of about ``part_bytes``, one for each shuffle partition at least.

    Beyond some terabytes parts grow with the square root of the size, so that lists sent from each part to
    each other part stay long enough to be worth a row.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, min(math.ceil(size / part_bytes), math.isqrt(size // 256)))


class KeySlices:
    """Slices of neighbouring keys, with about equal bytes of text each.

    ``order`` has a number for each slice; a slice of a higher one has higher keys only. A key whose rows alone are
    more than a slice has slices of its own, of one number, over which its rows are dealt by a hash of their text; so have
    rows without a key, which come last.
    """

    def __init__(self, cuts: list[int], hot: list[int], null_parts: int):
        """Distinct rising cuts, for each the number of parts of its own key (0: not on its own), and parts of null keys."""
        self.cuts = cuts
        self.rest, self.own, self.parts, order = [0], [], hot, [0]
        for parts in hot:
            self.own.append(len(order))
            order += [order[-1] + 1] * parts
            self.rest.append(len(order))
            order.append(order[-1] + 1)
        self.null, self.null_parts = len(order), max(1, null_parts)
        order += [order[-1] + 1] * self.null_parts
        self.order, self.n = np.array(order), len(order)

    def slice(self, key: Column, text: Column) -> Column:
        mark = F.xxhash64(text)
        nulls = F.lit(self.null) + F.pmod(mark, F.lit(self.null_parts))
        if not self.cuts:
            return F.when(key.isNull(), nulls).otherwise(0).cast("int")

        def constant(values: list, kind: str = "array<bigint>") -> Column:
            return F.from_json(F.lit(str(values)), kind)  # one literal, however many numbers there are

        width = math.isqrt(len(self.cuts)) + 1
        blocks = [self.cuts[i : i + width] for i in range(0, len(self.cuts), width)]
        block = F.size(F.filter(constant([b[0] for b in blocks]), lambda c: c <= key))
        inside = F.size(F.filter(F.element_at(constant(blocks, "array<array<bigint>>"), F.greatest(block, F.lit(1))), lambda c: c <= key))
        below = F.when(block == 0, 0).otherwise((block - 1) * width + inside).cast("int")  # cuts that are not above the key
        rest = F.element_at(constant(self.rest), below + 1)
        if any(self.parts):
            at = F.greatest(below, F.lit(1))
            parts = F.element_at(constant(self.parts), at)
            alone = (below > 0) & (parts > 0) & (F.element_at(constant(self.cuts), at) == key)
            rest = F.when(alone, F.element_at(constant(self.own), at) + F.pmod(mark, F.greatest(parts, F.lit(1)))).otherwise(rest)
        return F.when(key.isNull(), nulls).otherwise(rest).cast("int")


def key_slices(docs: DataFrame, key: str, text: str, n: int) -> KeySlices:
    """About ``n`` slices of ``docs``; keys must be whole numbers. Two passes over keys and lengths; the cuts reach the driver."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number; number other keys first")
    sizes = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).alias("b"), F.xxhash64(text).alias("h"))
    total, none = sizes.agg(F.sum("b"), F.sum(F.when(F.col("k").isNull(), F.col("b")))).first()
    if not total or n < 2:
        return KeySlices([], [], 1)
    null_parts = round(n * (none or 0) / total)
    shares = max(1, n - null_parts)
    # A row counts once for each 1/64 of a slice in it, what is left by chance of its hash: quantiles by bytes.
    unit = max(1, total // (64 * n))
    chance = F.pmod(F.xxhash64("h", "k"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("b") / unit + chance).cast("int")
    weighted = sizes.where(F.col("k").isNotNull() & (times > 0)).select("k", F.explode(F.sequence(F.lit(1), times)))
    wanted = [i / shares for i in range(1, shares)]
    found = weighted.agg(F.percentile_approx("k", wanted, max(10_000, 10 * n))).first()[0] if wanted else []
    repeats = Counter(found or [])
    cuts = sorted(repeats)
    return KeySlices(cuts, [repeats[c] if repeats[c] > 1 else 0 for c in cuts], null_parts)


def packed_codes(codes: np.ndarray) -> bytes:
    """Sorted 64-bit codes in about log2 of their mean distance plus 1.5 bits each (a Rice code of the differences).

    The first code is written out; of each difference the low ``k`` bits go as whole bytes and single bits, place by place, and
    the rest in unary.
    """
    n = len(codes)
    head = np.array([n, int(codes[0]) if n else 0], "<u8").tobytes()
    if n < 2:
        return head
    steps = np.diff(codes).astype("<u8")
    k = max(1, (int(codes[-1]) - int(codes[0])) // (n - 1)).bit_length() - 1
    high = (steps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, bool)
    unary[ends] = True
    octets = steps.view(np.uint8).reshape(-1, 8)
    whole = np.ascontiguousarray(octets[:, : k // 8].T).tobytes()
    bits = [np.packbits((steps >> np.uint64(b)) & np.uint64(1) != 0).tobytes() for b in range(k - k % 8, k)]
    return b"".join([head, bytes([k]), whole, *bits, np.packbits(unary).tobytes()])


def unpacked_codes(value: bytes) -> np.ndarray:
    n, first = (int(x) for x in np.frombuffer(value, "<u8", 2))
    out = np.zeros(n, np.uint64)
    if n:
        out[0] = first
    if n < 2:
        return out
    k, at, m = value[16], 17, n - 1
    octets = np.zeros((m, 8), np.uint8)
    octets[:, : k // 8] = np.frombuffer(value, np.uint8, m * (k // 8), at).reshape(k // 8, m).T
    steps, at, width = octets.view("<u8").ravel(), at + m * (k // 8), -(-m // 8)
    for b in range(k - k % 8, k):
        steps |= np.unpackbits(np.frombuffer(value, np.uint8, width, at), count=m).astype(np.uint64) << np.uint64(b)
        at += width
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(value, np.uint8, offset=at)))
    steps |= (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    out[1:] = steps
    return np.cumsum(out, dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Non-negative numbers, each in as many bytes as the largest one needs."""
    values = counts.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    # All low bytes first, then the next: high bytes are mostly zero and vanish in the shuffle's compression.
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked_counts(value: bytes) -> np.ndarray:
    width = value[0]
    raw = np.frombuffer(value, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def group_bounds(codes: np.ndarray, groups: int, bits: int = 64) -> np.ndarray:
    """Where each of ``groups`` equal ranges of the space of codes of ``bits`` bits begins in sorted codes; one more for the end."""
    step = (1 << bits) // groups
    firsts = np.array([i * step for i in range(groups)], np.uint64)
    return np.append(np.searchsorted(codes, firsts), len(codes))
