"""Document fingerprints by Order MinHash: signatures that are sensitive to edit distance (Marçais et al. 2019).

A text's elements are its k-mers of UTF-8 bytes with their occurrence numbers, so a k-mer that stands three times is
three elements. For each of ``orders`` random orders the ``length`` least elements are selected, put back into the
order in which they stand in the text, and hashed as a tuple; 16 bits of that are one part of the fingerprint, in
hexadecimal. Two texts' likeness is the share of equal parts: moved or repeated passages lower it, as do replaced ones.

The orders are rotations of one hash, each starting at a point of its own, so a text is sorted twice whatever their number.
K-mers are told apart by 44 bits of a hash. Equal texts have equal fingerprints. A text without bytes (null, empty) has
the empty fingerprint, like another such text (1.0) and unlike any other (0.0); one shorter than k is one element.
Of a text with fewer than ``length`` elements all are selected.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._text import mix64, released, shuffle_parts, slices, small_batches

#: Bits of a sort key that hold a place in the text; longer texts are sorted with places beside the keys.
_PLACE = 20
#: Buckets of neighbours for each shuffle partition, and sampled rows for each bucket's bounds.
BUCKETS_PER_PART, SAMPLE_PER_BUCKET = 4, 64


@dataclass(frozen=True)
class OrderMinHash:
    """How texts are fingerprinted: k-mers of ``k`` bytes (at most 8), ``orders`` parts, ``length`` k-mers a part."""

    k: int = 8
    orders: int = 64
    length: int = 2
    seed: int = 1

    def __post_init__(self):
        if not 1 <= self.k <= 8 or self.orders < 1 or self.length < 1:
            raise ValueError("k-mers have 1 to 8 bytes; orders and length are positive")

    def _starts(self) -> np.ndarray:
        return mix64(np.arange(1, self.orders + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & (2**64 - 1)) + np.uint64(self.seed))

    def parts(self, text: bytes) -> np.ndarray:
        """The fingerprint's parts as 16-bit numbers; none for an empty text."""
        if not text:
            return np.zeros(0, np.uint16)
        n, low = max(1, len(text) - self.k + 1), np.uint64((1 << _PLACE) - 1)
        padded = text + b"\0" * 8
        mers = np.ndarray((n,), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * self.k) - 1)
        if len(text) < self.k:
            mers = mers | np.uint64(len(text) << 56)
        at = np.arange(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mer, place = _ordered(mix64(mers), at, low)
            fresh = np.ones(n, bool)
            fresh[1:] = mer[1:] != mer[:-1]
            occurrence = at - np.maximum.accumulate(np.where(fresh, at, np.uint64(0)))
            element, place = _ordered(mix64(mer + occurrence * np.uint64(0xD6E8FEB86659FD93) + np.uint64(self.seed)), place, low)
            first = np.searchsorted(element, self._starts() >> np.uint64(_PLACE))
            chosen = (first[:, None] + np.arange(min(self.length, n))) % n
            where = place[chosen]
            in_text = np.take_along_axis(element[chosen], np.argsort(where, axis=1), axis=1)
            out = np.zeros(self.orders, np.uint64)
            for column in in_text.T:
                out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + column + np.uint64(1))
        return (out >> np.uint64(48)).astype(np.uint16)

    def fingerprint(self, text: bytes) -> str:
        return self.parts(text).astype(">u2").tobytes().hex()


def _ordered(hashes: np.ndarray, place: np.ndarray, low: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits of ``hashes`` in ascending order, equal ones by place, and their places."""
    upper = hashes >> np.uint64(_PLACE)
    if len(hashes) <= int(low) + 1:
        both = np.sort((upper << np.uint64(_PLACE)) | place)
        return both >> np.uint64(_PLACE), both & low
    order = np.lexsort((place, upper))
    return upper[order], place[order]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal parts of two fingerprints."""
    return float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))


def near(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns of the same scheme; null where one is null."""
    n = F.floor(F.length(a) / 4).cast("int")
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + (F.substr(a, 4 * i - 3, F.lit(4)) == F.substr(b, 4 * i - 3, F.lit(4))).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(0.0)).when(n == 0, F.lit(1.0)).otherwise(same / n)


def fingerprints(docs: DataFrame, text: str = "text", scheme: OrderMinHash = OrderMinHash(), name: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column, which replaces one of that name; nothing is shuffled."""
    kept = docs.drop(name) if name != text else docs
    carried = small_batches(kept.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    kind = carried.schema["row"].dataType.simpleString()

    def run(batches):
        for s in slices(batches, "text"):
            made = pa.array([scheme.fingerprint(s.text(i)) for i in range(s.n)], pa.string())
            yield pa.RecordBatch.from_arrays([s.rows.column(0), made], ["row", "made"])

    out = carried.mapInArrow(released(run), f"row {kind}, made string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept.columns if c != name], F.col("made").alias(name))


# ------------------------------------------------------------------ each document and the next one


def edited(text: str, following: str) -> str:
    """``text``, its last half (rounded down) replaced by the first as many code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(k1, k2, k3, id, text)``: ascending keys are descending ids, null ids last, equal ids by a hash of the text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    number = F.col(id_column).cast("bigint")
    return docs.select(number.isNull().cast("int").alias("k1"), F.bitwise_not(F.coalesce(number, F.lit(0))).alias("k2"), F.xxhash64(text).alias("k3"), number.alias("id"), text.alias("text"))


def _keys(batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
    return list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))


def _bounds(keys: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """Keys that cut the rows into about ``buckets`` even ranges, from a sample of about 64 rows a bucket."""
    every = max(1, keys.count() // (SAMPLE_PER_BUCKET * buckets))
    sample = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64("k2", "k3"), F.lit(every)) == 0).collect())
    step = max(1, len(sample) // buckets)
    return sorted({sample[i] for i in range(step, len(sample), step)})


def _firsts(keys: DataFrame, bounds: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """The least key of each range that has rows."""

    def run(batches):
        least: dict = {}
        for batch in batches:
            for key in _keys(batch):
                b = bisect.bisect_right(bounds, key)
                least[b] = min(key, least.get(b, key))
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*least.values(), strict=True))], ["b", "k1", "k2", "k3"])

    found = keys.mapInArrow(run, "b int, k1 bigint, k2 bigint, k3 bigint").groupBy("b").agg(F.min(F.struct("k1", "k2", "k3")).alias("k"))
    return {r["b"]: tuple(r["k"]) for r in found.collect()}  # a row a range


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scheme: OrderMinHash = OrderMinHash(), buckets: int | None = None) -> DataFrame:
    """Every text beside its edited form, whose second half the next document's beginning replaces.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. Documents follow one another by
    descending id, after the last the first; rows of equal id by a hash of their text, null ids last (-1 is an id). A document
    that is alone follows itself. Texts are shuffled once, to ranges of ids; the first row of each range is sent to
    the range before as well, so no range needs another.
    """
    keyed = _keyed(docs, id_column, text_column)
    keys = keyed.select("k1", "k2", "k3")
    bounds = _bounds(keys, buckets or BUCKETS_PER_PART * shuffle_parts(docs))
    firsts = _firsts(keys, bounds)
    ranges = sorted(firsts)
    before = {b: ranges[i - 1] for i, b in enumerate(ranges)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            prints = pa.array([scheme.fingerprint(s.text(i)) for i in range(s.n)], pa.string())
            keys = _keys(s.rows)
            b = [bisect.bisect_right(bounds, k) for k in keys]
            guests = [i for i, k in enumerate(keys) if firsts[b[i]] == k]
            rows = pa.array([*range(s.n), *guests])
            place = pa.array([*b, *(before[b[i]] for i in guests)], pa.int32())
            guest = pa.array([0] * s.n + [1] * len(guests), pa.int32())
            yield pa.RecordBatch.from_arrays([place, guest, *(s.rows.column(k).take(rows) for k in range(5)), prints.take(rows)], ["b", "guest", "k1", "k2", "k3", "id", "text", "fingerprint"])

    dealt = small_batches(keyed).mapInArrow(released(deal), "b int, guest int, k1 int, k2 bigint, k3 bigint, id bigint, text string, fingerprint string")
    order = ("b", "guest", "k1", "k2", "k3", "text")
    ordered = dealt.repartition(shuffle_parts(docs), "b").sortWithinPartitions(*order).select("b", "guest", "id", "text", "fingerprint")

    def parts(fingerprint: str) -> np.ndarray:
        return np.frombuffer(bytes.fromhex(fingerprint), ">u2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for b, guest, id_, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and last[0] == b:
                    _, asked, mine, fingerprint = last
                    changed = edited(mine, text).encode()
                    other, kept = scheme.parts(changed), parts(fingerprint)
                    out.append((asked, len(mine), hashlib.sha256(changed).hexdigest(), fingerprint, other.astype(">u2").tobytes().hex(), likeness(kept, other), likeness(kept, parts(own))))
                last = None if guest else (b, id_, text, own)
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ddl = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(released(compare), ddl)
