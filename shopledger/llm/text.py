"""Words, hashes and Arrow columns shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

# Odd factor of the rolling hash over word hashes.
FACTOR = 0x9E3779B97F4A7C17
SLICE_BYTES = 4 << 20  # text that one step of a Python worker unpacks


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session find the package where the driver found it.

    Workers see the environment of the JVM, which knows nothing of a path that the driver added later. Where the
    package is installed, or the path does not exist, this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has: for columns of an operator's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def in_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string column with about ``limit`` bytes each, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield column.slice(at, end - at)
        at = end


def by_slices(column: pa.Array, work: Callable[[pa.Array], pa.Array], kind: pa.DataType, limit: int = SLICE_BYTES) -> pa.Array:
    """``work`` applied to the slices of a column, put together again."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = [work(part).cast(kind) for part in in_slices(column, limit)]
    give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def words(text: bytes) -> list[bytes]:
    """The runs of bytes other than space and 0x09 to 0x0D; just these six bytes part words."""
    return text.split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spread 64-bit codes evenly (an invertible mix of shifts and odd factors)."""
    codes = codes ^ (codes >> np.uint64(33))
    codes = codes * np.uint64(0xFF51AFD7ED558CCD)
    codes ^= codes >> np.uint64(33)
    codes *= np.uint64(0xC4CEB9FE1A85EC53)
    return codes ^ (codes >> np.uint64(33))


def appended(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rolling hash of word runs after one more word each: run * FACTOR + word, modulo 2^64."""
    return codes * np.uint64(FACTOR) + hashes


def named(codes: np.ndarray, size: int) -> np.ndarray:
    """Final code of runs of ``size`` words."""
    return mixed(codes + np.uint64(size))


def give_back() -> None:
    """Hand freed memory back to the system; workers are reused, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
