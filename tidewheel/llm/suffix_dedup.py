"""Removal of long byte strings that repeat across documents, by a run-length index.

Every byte covered by a ``width``-byte string that also starts in a document with a smaller id goes.
Strings are judged on the input, overlaps count, and matches never cross documents.

1. *Routing.* Each ``width``-byte window is represented by its minimizer, the leftmost of its ``anchor``-byte
   substrings with the smallest hash: equal windows have equal minimizers at equal places. Packed 32-bit
   minimizer keys go to hash buckets, where a streamed dictionary finds those that two documents share. The
   number of buckets follows the counted bytes of text; a task takes its buckets one after another.
2. *Segments.* A document's windows with one shared minimizer form a segment, the bytes they cover. Segments
   go to their minimizer's bucket. Of equal ones that a task holds at once only the smallest document's travel;
   the others are marks already, so a passage that is everywhere sends one row a task. Windows of a key that
   very many documents share are routed by a hash of the whole window instead.
3. *Index.* Strings of a key that share a window share the minimizer and enough bytes around it, so segments
   whose bytes there are nobody else's are left out. Of a bucket's other distinct segments, the first of each key becomes a text whose Burrows-Wheeler
   transform is run-compressed, with the suffix array sampled at run ends. The other segments are streamed
   backwards through it in lock step (LF steps on runs; on a mismatch the neighbouring run end with the longer
   common prefix continues), which gives matching statistics; where a match reaches ``width`` the smallest
   document of that stretch of the transform decides. Segments with windows left over are halved by document,
   the earlier half indexed and the later one streamed, until none is left.
4. Windows that an earlier document has are marks. They travel packed by groups of documents, a row for each bucket and
   group, and meet the texts again by id. There is at most one mark for each place of a segment.

Documents equal to one with a smaller id are recognised by SHA-256 and not indexed. A null or empty text is
empty and stays so. A null id is kept as it is: it neither removes nor is removed from. Repeated rows are each
judged alone, and so are texts that share an id. An empty table gives an empty one. A text is held whole by the task that reads it; very
long ones form slices of their own. Input columns ``kept``, ``n_bytes`` and ``spans`` are replaced, all others,
whatever their names, stay. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._text import byte_table, from_binary, integer_ids, mix64, prefix_sums, released, shuffle_parts, slices, small_batches, span_hash
from tidewheel.operators.components import checkpointed

_TABLE = byte_table(23, lower=False)
_LOW = np.uint64(0xFFFFFFFF)
FLUSH = 1 << 20
#: Bytes of strings that one index holds, strings streamed through it at once, bytes of segments that a task gathers before sending.
PIECE_BYTES, STREAMS, SEND_BYTES = 1 << 18, 1 << 16, 12 << 20
#: Bytes of text whose windows are hashed at once: a window takes about a hundred bytes meanwhile.
HASH_BYTES = 1 << 19
#: Bytes of text that a bucket stands for, and bytes of segments that are judged together (more where one key has them).
BUCKET_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: A key in so many documents is hot; so many of the commonest hot keys are split by whole windows.
HOT_DOCS, HOT_KEYS = 1 << 14, 1 << 20
#: Pairs of bytes before and after a minimizer that strings are compared by, marks that are sent at once, and no minimizer's place.
CONTEXTS, SEND_MARKS, NOWHERE = 6, 1 << 20, (1 << 16) - 1


def minimizers(buf: np.ndarray, offsets: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(document, first window, windows, key, place)`` of each run of windows with one minimizer, in order; the place in the first window."""
    n, w = len(buf), width - anchor + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none
    at = np.arange(n - anchor + 1, dtype=np.int64)
    full = span_hash(prefix_sums(buf, _TABLE), at, at + anchor)
    low = (full & ~_LOW) | at.astype(np.uint64)
    step = 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < w:
        low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
    good = np.ones(n - width + 1, dtype=bool)
    for end in offsets[1:]:
        good[max(0, end - width + 1) : end] = False
    window = np.flatnonzero(good)
    if not len(window):
        return none, none, none, none.astype(np.uint64), none
    place = (low[window] & _LOW).astype(np.int64)
    head = np.ones(len(window), bool)
    head[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(head)
    start = window[first]
    count = np.diff(np.append(first, len(window)))
    return np.searchsorted(offsets, start, side="right") - 1, start, count, mix64(full[place[first]] ^ np.uint64(0x5DEECE66D)), place[first] - start


def routed(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32-bit key within it in the low half."""
    return ((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (key & _LOW)


def shared_keys(docs: DataFrame, width: int, anchor: int, parts: int, buckets: int, hot_docs: int) -> DataFrame:
    """``(doc, key, docs)``: minimizers of a document that another document has too (``docs`` null).

    Keys of ``hot_docs`` documents or more are also listed without a document, with their numbers of documents.
    """
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("step", pa.binary()), ("count", pa.binary())])

    def pack(batches):
        keys, ids, total = [], [], 0

        def flush():
            key, owner = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(key >> np.uint64(32), kind="stable")
            key, owner = key[order], owner[order]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            out = []
            for k, o in zip(np.split(key, cuts), np.split(owner, cuts), strict=True):
                head = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                out.append(
                    {
                        "bucket": int(k[0] >> np.uint64(32)),
                        "keys": (k & _LOW).astype(np.uint32).tobytes(),
                        "step": np.diff(o[head], prepend=0).tobytes(),
                        "count": np.diff(np.append(head, len(o))).astype(np.uint32).tobytes(),
                    }
                )
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for s in slices(batches, "text", HASH_BYTES):
            doc, _, _, key, _ = minimizers(s.buf, s.offsets, width, anchor)
            name = s.rows.column(0).to_numpy(zero_copy_only=False)
            keys.append(routed(key, buckets)), ids.append(name[doc].astype(np.int64))
            total += len(key)
            if total >= FLUSH:
                yield flush()
                keys, ids, total = [], [], 0
        if total:
            yield flush()

    def meet(batches):
        known, held, total, now = Shared(), [], 0, None

        def found():
            doc, key = known.meet(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key.view(np.int64)), pa.nulls(len(doc), pa.int64())], ["doc", "key", "docs"])

        def hot():
            key, seen = known.often(hot_docs)
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(seen)], ["doc", "key", "docs"])

        for batch in batches:
            columns = [from_binary(batch.column(i), t) for i, t in ((1, np.uint32), (2, np.int64), (3, np.uint32))]
            for bucket, k, step, count in zip(batch.column(0).to_pylist(), *columns, strict=True):
                if bucket != now and now is not None:
                    if total:
                        yield found()
                    yield hot()
                    known, held, total = Shared(), [], 0
                now = bucket
                held.append((k.astype(np.uint64) | np.uint64(bucket << 32), np.repeat(np.cumsum(step), count)))
                total += len(k)
                if total >= FLUSH:
                    yield found()
                    held, total = [], 0
        if total:
            yield found()
        yield hot()
        known, held = None, []

    packed = docs.select(F.col("id"), "text").filter("id is not null").mapInArrow(released(pack), "bucket long, keys binary, step binary, count binary")
    dealt = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return (dealt.sortWithinPartitions("bucket") if buckets > parts else dealt).mapInArrow(released(meet), "doc long, key long, docs long")


def hot_keys(pairs: DataFrame) -> np.ndarray:
    """The hot keys of ``shared_keys``; if there are more than ``HOT_KEYS``, only the commoner ones, down to a power of two."""
    listed = pairs.filter("doc is null").select("key", F.floor(F.log2("docs")).alias("level"))
    levels = sorted(((r["level"], r["n"]) for r in listed.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for level, n in levels:
        total += n
        if total > HOT_KEYS:
            break
        least = level
    if least is None:
        return np.zeros(0, np.uint64)
    return np.array([r["key"] for r in listed.filter(F.col("level") >= least).select("key").collect()], np.int64).view(np.uint64)


class Shared:
    """A growing dictionary from key to its first document, and the number of documents seen with it (a repeat may count again)."""

    def __init__(self):
        self.keys, self.docs, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New (document, key) pairs, distinct, of keys that two documents have by now."""
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        keep = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
        keys, docs = keys[keep], docs[keep]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        uniq, first = keys[start], docs[start]
        at = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        again = self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        shared = size > 1
        at = at[again]
        other = (self.seen[at] > 1) | (self.docs[at] != first[again]) | (size[again] > 1)
        tell = other & (self.seen[at] == 1)
        old = self.docs[at[tell]], uniq[again][tell]
        # one more sighting of a key's only document adds nothing
        self.seen[at] += np.where(other, size[again] - ((self.seen[at] == 1) & (self.docs[at] == first[again])), 0)
        shared[again] = other
        out = np.repeat(shared, size)
        merged = np.concatenate([self.keys, uniq[~again]])
        order = np.argsort(merged, kind="stable")
        self.docs = np.concatenate([self.docs, first[~again]])[order]
        self.seen = np.concatenate([self.seen, size[~again]])[order]
        self.keys = merged[order]
        return np.concatenate([docs[out], old[0]]), np.concatenate([keys[out], old[1]])

    def often(self, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of at least so many documents, and their numbers of documents."""
        hot = self.seen >= docs
        return self.keys[hot], self.seen[hot]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, the suffix array sampled at the ends of its runs.

    The text is the strings in order, each closed by a zero, bytes raised by one (UTF-8 has no byte 255). After
    construction only the text's bytes, the runs with their samples, and the smallest owners of stretches of
    rows that share their first ``width`` symbols are kept; the suffix array and its inverse are dropped.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, owner: np.ndarray, width: int):
        n, m = len(data), len(ends)
        size = self.size = n + m
        self.stop, self.owner = ends + np.arange(m), owner
        padded = np.zeros(size + 16, dtype=np.uint8)
        inside = np.ones(size, bool)
        inside[self.stop] = False
        padded[:size][inside] = data + np.uint8(1)
        self.words = np.ndarray(size + 8, "<u8", padded, strides=(1,))
        text = padded[:size]
        sa = self._sorted(np.ndarray(size, ">u8", padded, strides=(1,)).astype(np.uint64))
        bwt = text[sa - 1].astype(np.int16)
        bwt[sa == 0] = -1
        changed = np.append(True, bwt[1:] != bwt[:-1])
        head = self.head = np.flatnonzero(changed)
        self.symbol = bwt[head].astype(np.int64)
        self.length = np.diff(np.append(head, size))
        self.first_sample, self.last_sample = sa[head], sa[head + self.length - 1]
        by_symbol = self.by_symbol = np.argsort(self.symbol, kind="stable")
        #: row of the suffix one symbol longer, for the first row of each run
        self.target = np.empty(len(head), np.int64)
        self.target[by_symbol] = np.cumsum(self.length[by_symbol]) - self.length[by_symbol]
        self.symbol_at = self.symbol[by_symbol] * (size + 1) + head[by_symbol]
        self.mismatches = self.steps = 0
        self._owners(sa, head[1:], width)

    def _owners(self, sa: np.ndarray, begins: np.ndarray, width: int) -> None:
        """Stretches of more than one row that share ``width`` symbols, and their smallest owners."""
        # common prefixes of neighbouring rows: compared where a run begins, one less than the place before elsewhere
        size = self.size
        plcp, known = np.zeros(size, np.int64), np.zeros(size, np.int64)
        plcp[sa[begins]] = self.common(sa[begins], sa[begins - 1], size)
        known[sa[begins]] = sa[begins]
        known[sa[0]] = sa[0]
        known = np.maximum.accumulate(known)
        plcp = plcp[known] - (np.arange(size) - known)
        joined = np.append(plcp[sa[1:]] >= width, False)
        first = np.flatnonzero(joined & ~np.append(False, joined[:-1]))
        self.many, self.many_end = first, np.flatnonzero(~joined & np.append(False, joined[:-1])) + 1
        self.least = np.zeros(0, np.int64)
        if len(first):
            cuts = np.column_stack([self.many, self.many_end]).ravel()
            rows = self.owner[np.searchsorted(self.stop, sa)]
            self.least = np.minimum.reduceat(np.append(rows, rows[-1:]), cuts)[::2]

    def _sorted(self, key: np.ndarray) -> np.ndarray:
        """Suffix array: by eight symbols, then doubling where that leaves ties."""
        size, span = self.size, 8
        sa = np.argsort(key)
        head = np.append(True, np.diff(key[sa]) != 0)
        slots, rank = np.arange(size), np.empty(size, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
        while True:
            tied = ~(head & np.append(head[1:], True))
            if not tied.any():
                return sa
            slots = slots[tied]
            at = sa[slots]
            follow = np.where(at + span < size, rank[np.minimum(at + span, size - 1)] + 1, 0)
            key = rank[at] << 32 | follow
            order = np.argsort(key)
            key, at = key[order], at[order]
            sa[slots] = at
            head = np.append(True, np.diff(key) != 0)
            rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
            span *= 2

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
        """Common prefix lengths of pairs of suffixes, up to a limit: eight symbols at a time."""
        out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        limit = np.broadcast_to(limit, len(a))
        while len(alive):
            k = out[alive]
            differ = self.words[a[alive] + k] ^ self.words[b[alive] + k]
            same = differ == 0
            last = differ[~same]
            out[alive[~same]] += np.log2((last & (~last + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
            alive = alive[same]
            out[alive] += 8
            alive = alive[(out[alive] < limit[alive]) & (np.maximum(a[alive], b[alive]) + out[alive] < self.size)]
        return np.minimum(out, limit)

    def step(self, row: np.ndarray, place: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """One symbol backwards: row, text place and length of the longest match of each string.

        Where a row's symbol is another one, the nearest runs of the symbol above and below are compared with the
        match so far by their samples, and the longer continues.
        """
        run = np.searchsorted(self.head, row, side="right") - 1
        off = np.flatnonzero(self.symbol[run] != symbol)
        self.steps += len(row)
        self.mismatches += len(off)
        length = length + 1
        lost = off[:0]
        if len(off):
            row, place = row.copy(), place.copy()
            c, p, so_far = symbol[off], place[off], length[off] - 1
            at = np.searchsorted(self.symbol_at, c * (self.size + 1) + row[off])
            top = len(self.by_symbol) - 1
            up, down = self.by_symbol[np.maximum(at - 1, 0)], self.by_symbol[np.minimum(at, top)]
            reach = [np.where(self.symbol[r] == c, self.common(s[r], p, so_far), -1) for r, s in ((up, self.last_sample), (down, self.first_sample))]
            pick = reach[0] >= reach[1]
            best = np.where(pick, up, down)
            run[off] = best
            row[off] = np.where(pick, self.head[up] + self.length[up] - 1, self.head[down])
            place[off] = np.where(pick, self.last_sample[up], self.first_sample[down])
            length[off] = np.maximum(*reach) + 1
            lost = off[np.maximum(*reach) < 0]
        row, place = self.target[run] + row - self.head[run], place - 1
        if len(lost):  # a symbol that the text lacks: the empty match
            row[lost], place[lost], length[lost] = 0, self.size - 1, 0
        return row, place, length

    def stream(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """Matching statistics of the strings ``data[start:end]``, last symbol first.

        Yields (string numbers, place in data, row, text place, length): ``length`` symbols from the place on are the
        longest prefix of the string's rest that the text has, and stand at the text place. A string whose matches
        can't reach ``width`` any more is left.
        """
        who = np.flatnonzero(ends > starts)
        at, begin = ends[who].copy(), starts[who]
        row, place, length = np.zeros(len(who), np.int64), np.full(len(who), self.size - 1), np.zeros(len(who), np.int64)
        while len(who):
            at -= 1
            row, place, length = self.step(row, place, length, data[at].astype(np.int64) + 1)
            yield who, at, row, place, length
            on = (at > begin) & (length + at - begin >= width)
            if not on.all():
                who, at, begin, row, place, length = (x[on] for x in (who, at, begin, row, place, length))

    def least_owner(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The smallest owner of the ``width`` symbols at a match: of its stretch of rows, or of its one row."""
        out = self.owner[np.searchsorted(self.stop, place)]
        if len(self.many):
            at = np.searchsorted(self.many, row, side="right") - 1
            inside = (at >= 0) & (row < self.many_end[at])
            out[inside] = self.least[at[inside]]
        return out


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank within, and size of, the run of equal values that each value stands in."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(group)))
    return np.arange(len(group)) - np.repeat(head, size), np.repeat(size, size)


def earlier(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, key: np.ndarray, width: int, tell=None) -> np.ndarray:
    """For each byte place, whether the ``width``-byte window there is also in a string of the same key and a smaller owner.

    The strings are distinct. Of each key the first string is indexed and the others are streamed through the
    index; what is left is halved by owner again and again, the earlier half indexed, the later one streamed, so
    no string meets itself, and strings whose windows are all found drop out.
    """
    gone = np.zeros(len(data), bool)
    starts = np.append(0, ends[:-1])
    windows = ends - starts - width + 1

    def streamed(left: np.ndarray, right: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mark windows of the strings ``right`` that ``left`` strings of the same group have; those that are left over."""
        size = ends[left] - starts[left]
        piece = (np.cumsum(size) - size) // PIECE_BYTES
        cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(left) else []
        of, to = group[left], group[right]
        for a, z in zip(cuts, [*cuts[1:], len(left)], strict=False):
            own = left[a:z]
            text = np.concatenate([data[starts[i] : ends[i]] for i in own.tolist()])
            index = RunLengthIndex(text, np.cumsum(size[a:z]), owner[own], width)
            x, y = np.searchsorted(to, of[a], side="left"), np.searchsorted(to, of[z - 1], side="right")
            for some in np.array_split(right[x:y], max(1, -(-(y - x) // STREAMS))):
                for who, at, row, place, length in index.stream(data, starts[some], ends[some], width):
                    hit = np.flatnonzero(length >= width)
                    if len(hit):
                        hit = hit[index.least_owner(row[hit], place[hit]) < owner[some[who[hit]]]]
                        gone[at[hit]] = True
            if tell is not None:
                tell(index)
        total = np.append(0, np.cumsum(gone))
        found = total[starts[right] + windows[right]] - total[starts[right]]
        return right[found < windows[right]]

    order = np.lexsort((owner, key))
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])) if len(order) else 0
    rank, size = _runs(group[order])
    order, rank = order[size > 1], rank[size > 1]
    order = streamed(order[rank == 0], order[rank > 0], group)
    while True:
        rank, size = _runs(group[order])
        order, rank, size = (x[size > 1] for x in (order, rank, size))
        if not len(order):
            return gone
        first = rank < (size + 1) // 2
        rest = streamed(order[first], order[~first], group)
        late = np.zeros(len(ends), bool)
        late[rest] = True
        order = order[first | late[order]]
        half = group[order] * 2 + late[order]
        group[order] = np.cumsum(np.append(0, half[1:] != half[:-1]))


def segments(texts: DataFrame, width: int, anchor: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed segments of each task's documents that have shared keys, by bucket.

    Of equal segments that a task holds at once only the places in the smallest document travel on as segments; places
    in others have an earlier equal and are marks already, in rows of their own (``spans`` is not null). Windows of a
    hot key are segments of their own, by a hash of the whole window, so that no key gathers a large group. ``at`` is the
    minimizer's place in a segment.
    """
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("data", "size", "key", "at", "doc", "places", "start", "tag", "spans"))])

    def run(batches):
        # a segment's bytes tell its key
        held: dict[bytes, int] = {}
        occurrences: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush():
            of, key_, at_, doc_, start_, count_, tag_ = (np.concatenate(x) for x in zip(*occurrences, strict=True))
            n = len(held)
            key, at, size = np.zeros(n, np.uint64), np.zeros(n, np.uint16), np.zeros(n, np.int64)
            key[of], at[of], size[of] = key_, at_, count_ + width - 1
            owner = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(owner, of, doc_)
            late = doc_ > owner[of]
            # strings, and their places in the smallest document, in the order of buckets
            order = np.argsort(key >> np.uint64(32), kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            first = np.flatnonzero(~late)
            first = first[np.argsort(rank[of[first]], kind="stable")]
            places = np.bincount(rank[of[first]], minlength=n)
            names = list(held)
            data, ends, filled = b"".join([names[i] for i in order.tolist()]), np.append(0, np.cumsum(size[order])), np.append(0, np.cumsum(places))
            key, at, size, owner = key[order], at[order], size[order], owner[order]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            rows = []
            for a, z in zip(cuts, [*cuts[1:], n], strict=True):
                mine = first[filled[a] : filled[z]]
                rows.append(
                    {
                        "bucket": int(bucket[a]),
                        "data": data[ends[a] : ends[z]],
                        "size": size[a:z].astype(np.uint32).tobytes(),
                        "key": (key[a:z] & _LOW).astype(np.uint32).tobytes(),
                        "at": at[a:z].tobytes(),
                        "doc": owner[a:z].tobytes(),
                        "places": places[a:z].astype(np.uint32).tobytes(),
                        "start": start_[mine].astype(np.uint32).tobytes(),
                        "tag": tag_[mine].astype(np.uint32).tobytes(),
                    }
                )
            if late.any():
                spans = np.column_stack([start_[late], count_[late], tag_[late]]).astype(np.uint32)
                rows.append({"bucket": int(doc_[late][0]) % buckets, "doc": doc_[late].tobytes(), "spans": spans.tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for s in slices(batches, "text", HASH_BYTES):
            doc, start, count, key, at = minimizers(s.buf, s.offsets, width, anchor)
            key, at = routed(key, buckets), np.minimum(at, NOWHERE).astype(np.uint16)
            lists = s.rows.column(2)
            wanted = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
            holder = np.repeat(np.arange(s.n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.uint64)
            hit = np.isin(key ^ mix64(doc.astype(np.uint64)), wanted ^ mix64(holder))
            doc, start, count, key, at = doc[hit], start[hit], count[hit], key[hit], at[hit]
            often = np.isin(key, hot)
            if often.any():
                more = count[often]
                each = np.repeat(start[often] - np.cumsum(more) + more, more) + np.arange(more.sum())
                whole = span_hash(prefix_sums(s.buf, _TABLE), each, each + width)
                doc, start = np.concatenate([doc[~often], np.repeat(doc[often], more)]), np.concatenate([start[~often], each])
                count, key = np.concatenate([count[~often], np.ones(len(each), np.int64)]), np.concatenate([key[~often], routed(mix64(whole), buckets)])
                at = np.concatenate([at[~often], np.full(len(each), NOWHERE, np.uint16)])
            if not len(doc):
                continue
            raw, before = s.buf.tobytes(), len(held)
            of = np.array([held.setdefault(raw[p:q], len(held)) for p, q in zip(start.tolist(), (start + count + width - 1).tolist(), strict=True)])
            tags = np.zeros(s.n, np.int64)
            for i in np.unique(doc).tolist():
                tags[i] = zlib.crc32(s.text(i))
            ids = s.rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            occurrences.append((of, key, at, ids[doc], start - s.offsets[doc], count, tags[doc]))
            new, seen = np.unique(of, return_index=True)
            total += 40 * len(of) + int((count[seen[new >= before]] + width + 160).sum())
            if total >= SEND_BYTES:
                yield flush()
                held, occurrences, total = {}, [], 0
        if occurrences:
            yield flush()
        held, occurrences = {}, []

    return texts.mapInArrow(
        released(run), "bucket long, data binary, size binary, key binary, at binary, doc binary, places binary, start binary, tag binary, spans binary"
    )


def alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, key: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """Which of some distinct strings may have a window that another string of their key has too.

    Each window has the minimizer in it, at ``at`` in the string, so two strings that share one have the same ``l`` bytes before and
    ``width - anchor - l`` bytes after it. A few such pairs of lengths, rounded down, stand for all; hashes of those bytes meet.
    A string without a place may.
    """
    sums, mixed, may = prefix_sums(data, _TABLE), mix64(key.astype(np.uint64)), at == NOWHERE
    reach = width - anchor
    step = max(1, -(-(reach + 1) // CONTEXTS))
    place = starts + at
    for before in range(0, reach + 1, step):
        after = max(0, reach - before - step + 1)
        some = np.flatnonzero((at != NOWHERE) & (at >= before) & (place + anchor + after <= ends))
        around = span_hash(sums, place[some] - before, place[some] + anchor + after) ^ mixed[some]
        _, of, n = np.unique(around, return_inverse=True, return_counts=True)
        may[some[n[of] > 1]] = True
    return may


def _marked(doc: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """Marks of many documents, packed by document."""
    order = np.argsort(doc, kind="stable")
    doc, spans = doc[order], np.ascontiguousarray(spans[order], np.uint32)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array([x.tobytes() for x in np.split(spans, edge[1:])], pa.binary())], ["doc", "spans"])


def _grouped(held: list[tuple[np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    """Marks packed by group of documents."""
    doc, spans = (np.concatenate(x) for x in zip(*held, strict=True))
    group = (mix64(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    doc, spans, group = doc[order], np.ascontiguousarray(spans[order], np.uint32), group[order]
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    packed = [pa.array([x.tobytes() for x in np.split(values, edge[1:])], pa.binary()) for values in (doc, spans)]
    return pa.RecordBatch.from_arrays([pa.array(group[edge]), *packed], ["group", "doc", "spans"])


def judged(columns: list[tuple[np.ndarray, ...]], width: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Marks of one bucket's segments, given as packed rows, as ``(doc, spans)``; keys are taken a few at a time."""
    raw = b"".join(columns[0])
    size, key, at, doc, places, start, tag = (np.concatenate(x) for x in columns[1:])
    size, places = size.astype(np.int64), places.astype(np.int64)
    first, begin = np.cumsum(places) - places, np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    filled = np.cumsum(size[order])
    # strings of a key stay together
    ends = np.flatnonzero(np.append(key[order][1:] != key[order][:-1], True)) + 1
    part = filled[ends - 1] // CHUNK_BYTES
    cuts = ends[np.append(part[1:] != part[:-1], True)]
    for a, z in zip([0, *cuts[:-1]], cuts, strict=True):
        chunk = order[a:z]
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[b : b + n], len(seen)) for b, n in zip(begin[chunk].tolist(), size[chunk].tolist(), strict=True)])
        owner, own_key, own_at = np.full(len(seen), np.iinfo(np.int64).max), np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        np.minimum.at(owner, of, doc[chunk])
        own_key[of], own_at[of] = key[chunk], at[chunk]
        n = np.fromiter(map(len, seen), np.int64, len(seen))
        stop = np.cumsum(n)
        may = alike(np.frombuffer(b"".join(seen), np.uint8), stop - n, stop, own_at, own_key, width, anchor)
        left = np.cumsum(n * may)
        gone = earlier(np.frombuffer(b"".join([x for x, m in zip(seen, may.tolist(), strict=True) if m]), np.uint8), left[may], owner[may], own_key[may], width)
        # all windows of a segment that an earlier document has whole; of the others, those that are found
        count = places[chunk]
        occ = np.repeat(first[chunk] - np.cumsum(count) + count, count) + np.arange(count.sum())
        seg, by = np.repeat(of, count), np.repeat(doc[chunk], count)
        late = by > owner[seg]
        out = [(by[late], np.column_stack([start[occ[late]], (n[seg] - width + 1)[late], tag[occ[late]]]))]
        rest = ~late & may[seg]
        occ, seg, by = occ[rest], seg[rest], by[rest]
        wins = n[seg] - width + 1
        who = np.repeat(np.arange(len(occ)), wins)
        offset = np.arange(len(who)) - np.repeat(np.cumsum(wins) - wins, wins)
        found = gone[(left - n)[seg][who] + offset]
        who, offset = who[found], offset[found]
        if len(who):
            where = start[occ].astype(np.int64)[who] + offset
            head = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)))
            out.append((by[who[head]], np.column_stack([where[head], np.diff(np.append(head, len(where))), tag[occ][who[head]]])))
        doc_, spans = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(doc_):
            yield doc_, spans


def marks(packed: DataFrame, width: int, anchor: int, parts: int, buckets: int) -> DataFrame:
    """``(doc, spans)``: packed (start, count, CRC-32 of the text) of windows that a smaller document has too, a row a document.

    A task holds one bucket at a time; where it has several, its rows come sorted by bucket. Marks go to as many groups of
    documents as there are buckets, each task's together, and a group at a time is packed by document.
    """
    kinds = (np.uint8, np.uint32, np.uint32, np.uint16, np.int64, np.uint32, np.uint32, np.uint32)

    def run(batches):
        bucket, held, out, total = None, [], [], 0

        def told(some):
            nonlocal total
            for doc, spans in some:
                out.append((doc, spans))
                total += len(doc)
                if total >= SEND_MARKS:
                    yield sent()

        def sent():
            nonlocal total
            batch = _grouped(out, buckets)
            out.clear()
            total = 0
            return batch

        for batch in batches:
            numbers, spans = batch.column(0).to_pylist(), batch.column(9)
            for i, b in enumerate(numbers):
                if spans[i].is_valid:
                    known = np.frombuffer(spans[i].as_buffer(), np.uint32).reshape(-1, 3)
                    yield from told([(np.frombuffer(batch.column(5)[i].as_buffer(), np.int64), known)])
                    continue
                if b != bucket and held:
                    yield from told(judged(list(zip(*held, strict=True)), width, anchor))
                    held = []
                bucket = b
                held.append([np.frombuffer(batch.column(k + 1)[i].as_buffer(), t) for k, t in enumerate(kinds)])
        if held:
            yield from told(judged(list(zip(*held, strict=True)), width, anchor))
        held = []
        if out:
            yield sent()

    def gather(batches):
        now, held = None, []
        for batch in batches:
            for group, doc, spans in zip(batch.column(0).to_pylist(), from_binary(batch.column(1), np.int64), from_binary(batch.column(2), np.uint32), strict=True):
                if group != now and held:
                    yield _marked(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = group
                held.append((doc, spans.reshape(-1, 3)))
        if held:
            yield _marked(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = []

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        there = rows.repartitionById(parts, F.pmod(name, F.lit(parts)).cast("int"))
        return there.sortWithinPartitions(name) if buckets > parts else there

    told = dealt(packed, "bucket").mapInArrow(released(run), "group long, doc binary, spans binary")
    return dealt(told, "group").mapInArrow(released(gather), "doc long, spans binary")


def removed_spans(spans: bytes, text: bytes, width: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text; marks of another text with the same id are left out."""
    if not spans:
        return []
    pairs = np.frombuffer(spans, np.uint32).reshape(-1, 3).astype(np.int64)
    pairs = pairs[pairs[:, 2] == zlib.crc32(text)]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    out: list[list[int]] = []
    for a, c, _ in pairs.tolist():
        b = a + c + width - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 50,
    anchor: int | None = None,
    as_text: bool = False,
    hot_docs: int = HOT_DOCS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of ``docs`` with ``kept`` (binary), ``n_bytes``, ``spans`` (array of start, end) added.

    ``as_text``: ``kept`` is a string; of a character that a cut went through the other bytes go too.
    ``hot_docs``: documents from which on a key is split; ``bucket_bytes``: text that a bucket stands for. Neither changes the result.
    """
    anchor = anchor or max(1, width * 2 // 5)
    integer_ids(docs, id_column)
    small_batches(docs)
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "spans")]
    rest = [c for c in names if c not in (id_column, text_column)]
    prints = checkpointed(source.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("n")))
    parts = shuffle_parts(docs)
    total = prints.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    buckets = parts * -(-max(1, total) // (parts * bucket_bytes))
    # of equal texts the smallest id; only groups of two ids or more are listed, so the join can split a large one
    lowest = checkpointed(prints.filter(F.col("n") >= width).groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("high > low").drop("high"))
    copies = prints.join(lowest, "sha").filter("id > low").groupBy("id").agg(F.collect_set("sha").alias("copy"))
    pairs = checkpointed(shared_keys(source, width, anchor, parts, buckets, hot_docs))
    hot = hot_keys(pairs)
    shared = pairs.filter("doc is not null").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    whole = docs.select(
        F.col(id_column).cast("long").alias("__id"),
        F.col(text_column).alias("__text"),
        F.struct(F.lit(0).alias("__none"), F.col(id_column), *[F.col(f"`{c}`") for c in rest]).alias("__row"),
    ).repartition(parts, "__id")
    texts = (
        # left joins and the row struct keep this side's plan equal to the one below, so texts are dealt once
        whole.join(shared.withColumnRenamed("doc", "__id").hint("shuffle_hash"), "__id", "left")
        .join(copies.withColumnRenamed("id", "__id").hint("shuffle_hash"), "__id", "left")
        .filter("copy is null or not array_contains(copy, sha2(cast(__text as binary), 256))")
        .select("__id", F.col("__text").alias("text"), "keys", "__row")
    )
    found = marks(segments(texts, width, anchor, buckets, hot), width, anchor, parts, buckets).withColumnRenamed("spans", "marks")
    judged = (
        whole.join(found.withColumnRenamed("doc", "__id").hint("shuffle_hash"), "__id", "left")
        .join(copies.withColumnRenamed("id", "__id").hint("shuffle_hash"), "__id", "left")
        .select("__row", F.col("__text").alias("text"), "marks", "copy")
    )
    schema = judged.select("__row").schema
    kinds = f"__row {schema['__row'].dataType.simpleString()}, text string, kept {'string' if as_text else 'binary'}, n_bytes long, spans array<struct<start:int,end:int>>"

    def finish(batches):
        for batch in batches:
            kept, size, spans = [], [], []
            for text, mark, copy in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n = len(data)
                if copy.is_valid and hashlib.sha256(data).hexdigest() in copy.as_py():
                    runs = [(0, n)]
                else:
                    runs = removed_spans(mark.as_py() if mark.is_valid else b"", data, width)
                at, keep = 0, []
                for a, b in runs:
                    keep.append(data[at:a])
                    at = b
                kept.append(b"".join([*keep, data[at:]]) if runs else data)
                size.append(n)
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["__row", "text", "kept", "n_bytes", "spans"],
            )

    out = judged.mapInArrow(released(finish), kinds)
    return out.select(*[F.col("text" if c == text_column else f"__row.`{c}`").alias(c) for c in names], "kept", "n_bytes", "spans")
