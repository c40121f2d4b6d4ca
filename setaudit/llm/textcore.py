"""Vectorised text primitives on Arrow buffers, and the small Spark helpers every operator shares.

Python workers receive Arrow batches and never build a ``str`` per word: words are byte spans found with a
lookup table, and every word hash of a slice comes from one prefix-polynomial pass over its bytes.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit import runtime

SLICE_BYTES = 1 << 19  # bytes of text handled at once; a longer document is a slice of its own

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _ALNUM[_a:_b] = True
_ALNUM[[0xC2]] = True
CLASSES = {"ws": ~_SPACE, "alnum": _ALNUM}


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(int(base))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                step = np.full(size, self.base, np.uint64)
                step[0] = 1
                self.up = np.cumprod(step, dtype=np.uint64)
                step[1:] = self.inv
                self.down = np.cumprod(step, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets, validity) of a string column; a null counts as an empty span."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(col.is_valid())
    return raw, offsets, valid


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, at least one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a byte buffer, from one pass over it."""
    up, down = _BYTE_POWERS.get(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


class Words:
    """Words of some documents: byte spans relative to ``buf``, hashes, and each document's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: str = "ws"):
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.buf = raw[lo:hi]
        self.doc_off = offsets - lo
        n = len(self.buf)
        inside = np.zeros(n + 1, bool)
        inside[:n] = CLASSES[kind][self.buf]
        first = np.zeros(n + 1, bool)
        first[self.doc_off] = True
        prev = np.zeros(n + 1, bool)
        prev[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~prev | first))
        self.ends = np.flatnonzero(prev & (~inside | first))
        self.bounds = np.searchsorted(self.starts, self.doc_off)  # words of document d: bounds[d]:bounds[d+1]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_off) - 1), np.diff(self.bounds))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes; it takes no notice of where documents end."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (n, ...) between consecutive bounds; an empty segment is zero."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


ship, shared_dir, cut = runtime.send, runtime.shared_dir, runtime.checkpoint


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; for wide rows. It goes by ``drop``, or when the session's process ends."""
    spark = df.sparkSession
    path = runtime.scratch(spark, name)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(got)] = (weakref.ref(got), path)
    return got


_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def drop(df: DataFrame) -> None:
    """Delete a table that ``table`` wrote, when all that reads it has been computed."""
    held, path = _PATHS.pop(id(df), (lambda: None, ""))
    if held() is df:
        runtime.discard(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_id(col: str = "doc_id"):
    return F.col(col).cast("long")
