"""Shared helpers: fixed text rules, size-bounded row slices and word hashes."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.session import scratch_path, shared_dir

# Fixed values of the contracts: white space and the letters that are folded.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SLICE_BYTES = 1 << 20


def fold_case(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (lineage is cut)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration in the shared folder: each round is written,
    read back without the plan that made it, and the round before is removed."""

    def __init__(self, spark):
        self.spark, self.last = spark, None

    def next(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "round")
        df.write.parquet(path)
        if self.last:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column clashes with it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs


def row_slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


# --- word hashes --------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_R = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8
_R_INV = pow(_R, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, r, np.uint64))))
                          for r in (np.uint64(_R), np.uint64(_R_INV))]
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _hash_piece(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one piece; a document's
    start ends the word before it."""
    n = len(buf)
    space = _IS_SPACE[buf]
    edge = np.ones(n + 1, bool)  # edge[i]: no word runs from i-1 into i
    edge[1:n] = space[:-1]
    edge[doc_starts[doc_starts < n]] = True
    starts = np.flatnonzero(~space & edge[:n])
    last = edge[1:].copy()
    last[:-1] |= space[1:]
    ends = np.flatnonzero(~space & last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(data: np.ndarray, offs: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows a..b and the word offsets per row.

    Words are maximal runs of bytes outside [\\x20\\x09-\\x0D], A-Z folded.
    A row longer than a slice is hashed piece by piece, cut at white space."""
    lo, hi = int(offs[a]), int(offs[b])
    if hi - lo <= SLICE_BYTES:
        if hi == lo:
            return np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64)
        h, starts = _hash_piece(data[lo:hi], offs[a:b] - lo)
        return h, np.searchsorted(starts, offs[a:b + 1] - lo)
    parts, at = [], lo  # one long row
    while at < hi:
        end = min(at + SLICE_BYTES, hi)
        while end < hi and not _IS_SPACE[data[end]]:
            step = np.flatnonzero(_IS_SPACE[data[end:min(end + SLICE_BYTES, hi)]])
            end = end + int(step[0]) if len(step) else min(end + SLICE_BYTES, hi)
        parts.append(_hash_piece(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])
