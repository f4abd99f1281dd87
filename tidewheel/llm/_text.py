"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Word classes used here are defined on ASCII bytes only and every byte of a non-ASCII character is
a word byte, so working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

#: Bytes of text handled at once inside a task; longer texts form a slice of their own.
SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z share those of a-z."""
    with np.errstate(over="ignore"):
        table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = word_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, so A-Z belong to words too.
ALNUM = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_POW = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_P = 0x9E3779B97F4A7C55 | 1
_PINV = pow(_P, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POW[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for i, base in enumerate((_P, _PINV)):
                steps = np.full(size, np.uint64(base & (2**64 - 1)), dtype=np.uint64)
                steps[0] = 1
                _POW[i] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def prefix_sums(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``len(buf) + 1`` prefix sums of a polynomial hash modulo 2**64."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the byte spans ``[start, end)``."""
    _, inv = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[start]) * inv[start])


class Slice:
    """Some whole texts as one byte buffer: ``offsets[i]:offsets[i + 1]`` is text ``i`` (null: empty)."""

    def __init__(self, rows: pa.RecordBatch, column: str):
        text = rows.column(rows.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        text = text.cast(pa.large_string()).cast(pa.large_binary())
        n, at = len(text), text.offset
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        data = text.buffers()[2] if n else None
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.rows, self.n = rows, n
        self.buf = whole[offsets[0] : offsets[-1]]
        self.offsets = (offsets - offsets[0]).astype(np.int64)

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and first-word index per text (``n + 1`` entries) of all words, in order."""
        inside = np.zeros(len(self.buf) + 1, dtype=bool)
        inside[:-1] = table[self.buf]
        before = np.zeros(len(self.buf) + 1, dtype=bool)
        before[1:] = inside[:-1]
        cuts = self.offsets[1:-1]
        starts, ends = inside & ~before, before & ~inside
        if len(cuts):
            starts[cuts] = inside[cuts]
            cuts = cuts[cuts > 0]
            ends[cuts] = before[cuts]
            # an empty text repeats a cut; both marks stay idempotent
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
        return start, end, np.searchsorted(start, self.offsets)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text; a text is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        total = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield Slice(batch.slice(at, to - at), column)
            at = to


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches bounded, for long texts and packed rows.

    The limits are read when a query runs, so they stay lowered in the session; larger ones are never set.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub(r"\D", "", conf.get(key)) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda keep: 0


def release() -> None:
    """Give memory that a task has freed back to the system: workers outlive tasks, and other stages share their memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


#: What drops the tables that an operator keeps in its workers from task to task, by the operator's name.
KEPT: dict[str, Callable[[], None]] = {}


def forget(keeps: str | None) -> None:
    """Drop the tables that other operators' tasks left in this worker."""
    for name, drop in KEPT.items():
        if name != keeps:
            drop()


#: Bytes of what a task's function returns at once.
RETURN_BYTES = 4 << 20


def released(run, keeps: str | None = None):
    """``run`` as a task's function: what it yields travels a few megabytes at a time, and memory is given back at the end.

    ``keeps``: whose tables stay in the worker; those of others go before the task starts.
    """

    def whole(batches):
        forget(keeps)
        try:
            for batch in run(batches):
                step = max(1, int(batch.num_rows * RETURN_BYTES // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
        finally:
            release()

    return whole


def integer_ids(df: DataFrame, column: str) -> None:
    """Refuse ids that are not integers: a cast would make nulls of them."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must be an integer, not {kind.simpleString()}")


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which operators size their buckets by."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def from_binary(values: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=dtype) for v in values]
