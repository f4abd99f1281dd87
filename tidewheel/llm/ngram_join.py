"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

A document's row of the incidence matrix is its set of distinct word n-grams. Two rows link when
``100 * overlap >= percent * union``, decided on exact overlap counts.

1. *Bounds.* Linked sets share all but (100 - percent) % of either set's n-grams. So a set is left out as soon as
   more of its n-grams than that occur in no other set. This is first counted on a hashed share of all n-grams:
   packed 32-bit keys go to hash buckets, where a streamed dictionary tells which keys two sets have. Key
   collisions can only keep a set in.
2. *Blocking.* Of the sets left, all n-grams are counted exactly. With the n-grams in one order, rarest
   first, linked sets share one of the first (100 - percent) % + 1 of each. Sets that share such an n-gram are
   joined by one edge to the first of them, never in all pairs; the connected components of these edges are
   the blocks of the product. No link is lost, whatever the data.
3. Equal rows are collapsed to one representative. A block with more n-grams than ``block_grams`` is
   cut into tiles, each with the block's few pivot rows added. Each tile's sparse product is taken a row
   at a time, overlap counts are accumulated by bincount, entries outside the size-derived bounds are
   discarded, and rows already known to be connected need no further product.
4. Rows of a cut block that are not yet connected with its largest component are multiplied with all
   tiles of that block, so nothing is missed between tiles.
5. Links themselves are wanted by ``jaccard_links`` and ``links=True``. As they lie inside components, each
   component is one more product of its representatives. A component of many n-grams is first cut by size class, so that
   linked sets are of one class or of neighbouring ones, then each class into tiles; only pairs of tiles of such classes
   are multiplied. N-grams of many rows of a tile are multiplied as a dense block, the others a strip of rows at a time.

Nulls and empty texts have an empty set and link with nothing; a null id is kept with its own row.
Repeated rows are each returned; rows of one id are taken for one document. A text is one set however long; an empty
table gives an empty one; other columns, whatever their names, are not looked at. Ids must be integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm._text import SPACES, byte_table, from_binary, integer_ids, mix64, prefix_sums, released, shuffle_parts, slices, small_batches, span_hash
from tidewheel.operators.components import checkpointed, connected_components

_TABLE = byte_table(11, lower=True)
#: Packed part hashes a task holds before it sends them on.
FLUSH = 1 << 20
#: Counted n-grams of a bucket of the first count.
BUCKET_GRAMS = 8 << 20
#: A set of ids is broadcast only up to this many rows; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Counts, and postings, of a strip of rows that is multiplied at once.
STRIP = 2 << 20


def gram_sets(s, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a slice."""
    start, end, first = s.words(SPACES)
    words = span_hash(prefix_sums(s.buf, _TABLE), start, end)
    odd = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in range(n + 1)]
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for k in range(n):
            grams = mix64(grams * odd[k] + words[k : k + len(grams)])
        for i in range(s.n):
            a, z = first[i], first[i + 1]
            if z - a >= n:
                yield np.unique(grams[a : z - n + 1])
            elif z > a:
                whole = np.uint64(z - a)
                for w in words[a:z]:
                    whole = mix64(np.array([whole * odd[n] + w]))[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(grams: np.ndarray) -> int:
    """A 64-bit hash of a set; equal sets share it."""
    with np.errstate(over="ignore"):
        return int(grams.sum(dtype=np.uint64).view(np.int64))


def set_table(docs: DataFrame, id_column: str, text_column: str, n: int, percent: int) -> DataFrame:
    """``(id, n, h1, h2, c)``: set size, a 128-bit hash of the set, and how many n-grams the first count sees."""

    def run(batches):
        for s in slices(batches, "text"):
            size, h1, h2, counted = [], [], [], []
            with np.errstate(over="ignore"):
                for g in gram_sets(s, n):
                    size.append(len(g))
                    counted.append(len(_counted(g, percent)))
                    h1.append(set_key(g))
                    h2.append(np.bitwise_xor.reduce(mix64(g)) if len(g) else np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [
                    s.rows.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(h1, pa.int64()),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.array(counted, pa.int64()),
                ],
                ["id", "n", "h1", "h2", "c"],
            )

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(
        released(run), "id long, n long, h1 long, h2 long, c long"
    )


class SharedKeys:
    """A growing dictionary from key to its first set, which tells each (key, set) once two sets have the key."""

    def __init__(self):
        self.keys, self.sets, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pairs = np.zeros(0, np.uint64)

    def meet(self, keys: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Sets, one entry for each of their keys that is newly known to be shared."""
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        keep = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]))
        keys, sets = keys[keep], sets[keep]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        uniq, first = keys[start], sets[start]
        shared, again = size > 1, np.zeros(len(uniq), bool)
        late_keys, late_sets = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
            again = self.keys[at] == uniq
            shared |= again & (self.told[at] | (self.sets[at] != first))
            late = again & shared & ~self.told[at]
            late_keys, late_sets = uniq[late], self.sets[at[late]]
            self.told[at[again]] |= shared[again]
        merged = np.concatenate([self.keys, uniq[~again]])
        order = np.argsort(merged, kind="stable")
        self.sets = np.concatenate([self.sets, first[~again]])[order]
        self.told = np.concatenate([self.told, shared[~again]])[order]
        self.keys = merged[order]
        out = np.repeat(shared, size)
        keys, sets = np.concatenate([keys[out], late_keys]), np.concatenate([sets[out], late_sets])
        with np.errstate(over="ignore"):
            pair, at = np.unique(mix64(keys) + mix64(sets.view(np.uint64)), return_index=True)
        new = ~np.isin(pair, self.pairs)
        self.pairs = np.union1d(self.pairs, pair[new])
        return sets[at[new]]


def counted_share(percent: int) -> int:
    """Thousandths of all n-grams that the first count looks at: well over what a set may lack."""
    return min(1000, 25 * (100 - percent))


def _counted(grams: np.ndarray, percent: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix64(grams + np.uint64(0x1234567))
    return mixed[(mixed >> np.uint64(44)) % np.uint64(1000) < np.uint64(counted_share(percent))]


def _by_bucket(packed: DataFrame, parts: int, buckets: int) -> DataFrame:
    """Rows dealt by bucket; where a task has several buckets, one after another."""
    dealt = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("bucket") if buckets > parts else dealt


def shared_counts(docs: DataFrame, text_column: str, n: int, percent: int, parts: int, buckets: int) -> DataFrame:
    """``(h1, shared)``: how many of a set's counted n-grams another set has too. A task holds one bucket at a time."""
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("sets", pa.binary()), ("counts", pa.binary())])

    def rows(bucket: np.ndarray, keys: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, keys, sets = bucket[order], keys[order], sets[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = []
        for b, k, o in zip(*(np.split(x, cuts) for x in (bucket, keys, sets)), strict=True):
            head = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            out.append({"bucket": int(b[0]), "keys": k.tobytes(), "sets": o[head].tobytes(), "counts": np.diff(np.append(head, len(o))).astype(np.uint32).tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def pack(batches):
        held, names, total = [], [], 0

        def flush():
            keys = np.concatenate(held)
            return rows((keys >> np.uint64(32)) % np.uint64(buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.repeat(np.array(names, np.int64), [len(x) for x in held]))

        for s in slices(batches, "text"):
            for g in gram_sets(s, n):
                if len(g):
                    held.append(_counted(g, percent))
                    names.append(set_key(g))
                    total += len(held[-1])
            if total >= FLUSH:
                yield flush()
                held, names, total = [], [], 0
        if total:
            yield flush()

    def meet(batches):
        known, keys, sets, total = SharedKeys(), [], [], 0

        def found():
            who, count = np.unique(known.meet(np.concatenate(keys).astype(np.uint64), np.concatenate(sets)), return_counts=True)
            # a packed row for each bucket of sets
            bucket = mix64(who.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            who, count, bucket = who[order], count[order].astype(np.uint32), bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            out = [{"bucket": int(b[0]), "sets": w.tobytes(), "counts": c.tobytes()} for b, w, c in zip(*(np.split(x, cuts) for x in (bucket, who, count)), strict=True) if len(w)]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("sets", pa.binary()), ("counts", pa.binary())]))

        now = None
        for batch in batches:
            columns = [from_binary(batch.column(i), t) for i, t in ((1, np.uint32), (2, np.int64), (3, np.uint32))]
            for b, k, o, c in zip(batch.column(0).to_pylist(), *columns, strict=True):
                if b != now and now is not None:
                    if total:
                        yield found()
                    known, keys, sets, total = SharedKeys(), [], [], 0
                now = b
                keys.append(k), sets.append(np.repeat(o, c))
                total += len(k)
                if total >= FLUSH:
                    yield found()
                    keys, sets, total = [], [], 0
        if total:
            yield found()

    def add(batches):
        now, sets, counts = None, [], []

        def summed():
            who, at = np.unique(np.concatenate(sets), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(total)], ["h1", "shared"])

        for batch in batches:
            for b, s, c in zip(batch.column(0).to_pylist(), from_binary(batch.column(1), np.int64), from_binary(batch.column(2), np.uint32), strict=True):
                if b != now and sets:
                    yield summed()
                    sets, counts = [], []
                now = b
                sets.append(s), counts.append(c)
        if sets:
            yield summed()

    packed = docs.select(F.col(text_column).alias("text")).mapInArrow(released(pack), "bucket long, keys binary, sets binary, counts binary")
    told = _by_bucket(packed, parts, buckets).mapInArrow(released(meet), "bucket long, sets binary, counts binary")
    return _by_bucket(told, parts, buckets).mapInArrow(released(add), "h1 long, shared long")


def gram_rows(texts: DataFrame, n: int) -> DataFrame:
    """``(id, h, n, g)``: every n-gram of every text with its set's key, for the few texts that the bounds leave."""

    def run(batches):
        for s in slices(batches, "text"):
            grams = list(gram_sets(s, n))
            size = np.array([len(g) for g in grams], np.int64)
            if size.sum():
                ids = s.rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.array([set_key(g) for g in grams], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, size)), pa.array(np.repeat(keys, size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(grams).view(np.int64))],
                    ["id", "h", "n", "g"],
                )

    return texts.select("id", "text").mapInArrow(released(run), "id long, h long, n long, g long")


def block_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` whose components hold every link, from ``gram_rows`` of the documents.

    An n-gram takes one place of its set's prefix, however many rows repeat the set; repeated rows count in ``df``,
    which only has to be one order for all sets.
    """
    frequency = rows.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    known = rows.join(frequency, "g", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.dense_rank().over(Window.partitionBy("id", "h").orderBy("df", "g"))
    prefix = known.withColumn("place", place).filter(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).filter("df > 1").select("id", "g")
    first = prefix.groupBy("g").agg(F.min("id").alias("a"), F.count("*").alias("m")).filter("m > 1").select("g", "a")
    return prefix.join(first, "g").filter("a <> id").select("a", F.col("id").alias("b")).distinct()


def link_tile(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """Labels of the tile's rows after linking, by a row-at-a-time sparse product.

    ``label``: components known before, as row numbers; ``rows``: the only rows to multiply.
    Without ``rows``, products go on until every row outside the largest component has had one, so each
    pair of rows that could still join two components is counted exactly.
    """
    m = len(sets)
    label = np.arange(m) if label is None else label.copy()
    if m < 2:
        return label
    size = np.array([len(x) for x in sets], dtype=np.int64)
    columns, column = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(m), size)[np.argsort(column, kind="stable")]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(columns)))])
    starts = np.concatenate([[0], np.cumsum(size)])
    shared = np.concatenate([[0], np.cumsum((ptr[1:] - ptr[:-1])[column])])
    shared = shared[starts[1:]] - shared[starts[:-1]]
    count = np.bincount(label, minlength=m)
    todo = np.zeros(m, bool)
    todo[np.arange(m) if rows is None else rows] = True
    i = int(np.argmax(np.where(todo, shared, -1)))
    while True:
        todo[i] = False
        other = (label != label[i]) & (100 * size >= percent * size[i]) & (100 * size[i] >= percent * size)
        if other.any():
            c = column[starts[i] : starts[i + 1]]
            n = ptr[c + 1] - ptr[c]
            take = np.repeat(ptr[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
            overlap = np.bincount(postings[take], minlength=m)
            hit = other & (overlap > 0) & (100 * overlap >= percent * (size[i] + size - overlap))
            joined = np.unique(label[hit])
            if len(joined):
                label[np.isin(label, joined)] = label[i]
                count[label[i]] += count[joined].sum()
                count[joined] = 0
        left = np.flatnonzero(todo & (label != np.argmax(count)) if rows is None else todo)
        if not len(left) or count.max() == m:
            return label
        i = int(left[0])


def _tiles(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges inside tiles: ``rows`` has key, id, text, label (long, may be null), wanted (boolean)."""

    def close(ids, sets, labels, wanted):
        unique: dict = {}
        given = np.array([unique.setdefault(("id", i) if x is None else x, k) for k, (i, x) in enumerate(zip(ids, labels, strict=True))])
        only = None if all(wanted) else np.flatnonzero(wanted)
        out = link_tile(sets, percent, given, only)
        low: dict = {}
        for i, k in zip(ids, out, strict=True):
            low[k] = min(i, low.get(k, i))
        return [low[k] for k in out], ids

    def run(batches):
        key, ids, sets, labels, wanted = None, [], [], [], []

        def ended():
            a, b = close(ids, sets, labels, wanted)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for s in slices(batches, "text"):
            for k, i, lab, want, g in zip(*(s.rows.column(c).to_pylist() for c in (0, 1, 3, 4)), gram_sets(s, n), strict=True):
                if k != key and ids:
                    yield ended()
                    ids, sets, labels, wanted = [], [], [], []
                key = k
                ids.append(i), sets.append(g), labels.append(lab), wanted.append(want)
        if ids:
            yield ended()

    return (
        rows.select("key", "id", "text", "label", "wanted")
        .repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(released(run), "a long, b long")
    )


def _with_text(keys: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Join texts to the rows of ``keys``; ids are broadcast only where their counted number is small."""
    text = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    ids = keys.select("id").distinct()
    small = ids.count() <= BROADCAST_IDS
    if small:
        text = text.join(F.broadcast(ids), "id", "left_semi")
    return keys.join(text, "id")


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers ``(i, j)`` and overlaps of linked sets, some at a time: pairs of side 1 with side 2, or all within side 0.

    N-grams that an eighth of the rows have are multiplied as dense columns, which are at most eight times the n-grams;
    overlaps in the others are counted by bincount over their postings.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    columns, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    dense = (df > 1) & (8 * df >= m)
    rank = np.cumsum(dense) - 1
    matrix = np.zeros((m, int(dense.sum())), np.float32)
    inside = dense[column]
    matrix[row[inside], rank[column[inside]]] = 1
    inside = ((df > 1) & ~dense)[column]
    column, row = column[inside], row[inside]
    postings = row[np.argsort(column, kind="stable")]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(columns)))])
    starts = np.searchsorted(row, np.arange(m + 1))
    n = np.diff(ptr)[column]
    work = np.concatenate([[0], np.cumsum(n)])
    first = np.flatnonzero(side < 2)
    both = side.any()
    at = 0
    while at < len(first):
        # a strip of rows whose counts and postings are bounded; one row's postings are at most the tile's n-grams
        to = at + 1
        while to < len(first) and (to + 1 - at) * m <= STRIP and work[starts[first[to] + 1]] - work[starts[first[at]]] <= STRIP:
            to += 1
        strip = first[at:to]
        overlap = (matrix[strip] @ matrix.T).astype(np.int64)
        own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in strip])
        if len(own):
            count = n[own]
            take = np.repeat(ptr[column[own]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat(np.searchsorted(strip, row[own]) * m, count) + postings[take]
            overlap += np.bincount(cell, minlength=len(strip) * m).reshape(len(strip), m)
        union = size[strip][:, None] + size[None, :] - overlap
        hit = (overlap > 0) & (100 * overlap >= percent * union)
        hit &= (side == 2)[None, :] if both else np.arange(m)[None, :] > strip[:, None]
        i, j = np.nonzero(hit)
        yield strip[i], j, overlap[i, j]
        at = to


def _tile_pairs(member: DataFrame, percent: int, block_grams: int) -> DataFrame:
    """``(key, side, id, h1, copies)``: each pair of tiles that may hold links of a component, by key.

    ``member`` has component, id, h1, n, copies. A component of up to half of ``block_grams`` n-grams is one tile. Of a larger
    one, a class holds the sizes within a factor of a little over 100 / percent, so linked sets are at most one class apart.
    """
    half = max(1, block_grams // 2)
    whole = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).filter("m > 1")
    size_class = F.col("n") if percent >= 100 else F.floor(F.log("n") / (1.001 * math.log(100 / max(1, percent))))
    rows = member.join(whole, "component").withColumn("class", F.when(F.col("grams") <= half, F.lit(0)).otherwise(size_class).cast("long"))
    tiles = checkpointed(rows.groupBy("component", "class").agg(F.ceil(F.sum("n") / half).cast("int").alias("tiles")))
    near = [tiles.select("component", (F.col("class") - d).alias("class"), F.col("tiles").alias(name)) for d, name in ((-1, "below"), (1, "above"))]
    beside = tiles.join(near[0], ["component", "class"], "left").join(near[1], ["component", "class"], "left")
    rows = rows.join(beside, ["component", "class"]).withColumn("tile", F.pmod(F.xxhash64("id", "h1"), F.col("tiles")).cast("int"))

    def meets(side, c1, t1, c2, t2):
        return F.struct(F.concat_ws(":", "component", c1, t1, c2, t2).alias("key"), side.cast("int").alias("side"))

    def upto(count):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    c, t = F.col("class"), F.col("tile")
    pairs = F.concat(
        F.transform(F.sequence(t, F.col("tiles") - 1), lambda j: meets(F.when(j == t, 0).otherwise(1), c, t, c, j)),
        F.transform(upto(t), lambda j: meets(F.lit(2), c, j, c, t)),
        F.transform(upto(F.col("above")), lambda j: meets(F.lit(1), c, t, c + 1, j)),
        F.transform(upto(F.col("below")), lambda j: meets(F.lit(2), c - 1, j, c, t)),
    )
    return rows.select("id", "h1", "copies", F.explode(pairs).alias("p")).select("p.key", "p.side", "id", "h1", "copies")


def _products(keys: DataFrame, texts: DataFrame, n: int, percent: int, counts: bool) -> DataFrame:
    """Links of all tile pairs: ``(a, b, overlap)``, or with ``counts`` ``(id, h1, links)``, a partial count weighted by copies."""
    names = ["id", "h1", "links"] if counts else ["a", "b", "overlap"]

    def run(batches):
        key, seen, ids, sides, copies, sets = None, set(), [], [], [], []

        def ended():
            if len(sets) < 2:
                return
            (who, name), side, weight = np.array(ids, np.int64).T, np.array(sides), np.array(copies, np.int64)
            total = np.zeros(len(who), np.int64)
            for i, j, overlap in linked_pairs(sets, side, percent):
                if counts:
                    total += np.bincount(i, weight[j], len(who)).astype(np.int64) + np.bincount(j, weight[i], len(who)).astype(np.int64)
                elif len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(who[i], who[j])), pa.array(np.maximum(who[i], who[j])), pa.array(overlap)], names)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(name), pa.array(total)], names)

        for s in slices(batches, "text"):
            for k, i, h, side, copy, g in zip(*(s.rows.column(c).to_pylist() for c in range(5)), gram_sets(s, n), strict=True):
                if k != key:
                    yield from ended()
                    key, seen, ids, sides, copies, sets = k, set(), [], [], [], []
                # repeated rows of an id, and its other texts, come with it
                if (i, h) not in seen and set_key(g) == h:
                    seen.add((i, h)), ids.append((i, h)), sides.append(side), copies.append(copy), sets.append(g)
        yield from ended()

    dealt = _with_text(keys, texts, "id", "text").select("key", "id", "h1", "side", "copies", "text").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(released(run), ", ".join(f"{x} long" for x in names))


def _connected(docs, id_column, text_column, n, percent, block_grams, bucket_grams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``set_table``, texts that may link (one a set), and the component of each of their ids."""
    integer_ids(docs, id_column)
    small_batches(docs)
    table = checkpointed(set_table(docs, id_column, text_column, n, percent))
    parts = shuffle_parts(docs)
    counted = table.agg(F.sum("c").alias("c")).first()["c"] or 0
    shared = shared_counts(docs, text_column, n, percent, parts, parts * -(-max(1, counted) // (parts * bucket_grams)))
    alone = F.col("c") - F.coalesce("shared", F.lit(0))
    rep = table.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.any_value("c").alias("c"))
    left = checkpointed(rep.join(shared, "h1", "left").filter(alone <= F.floor(F.col("n") * (100 - percent) / 100)).select("id", "n"))
    # the texts that are left are few; written once, they spare three more scans of all
    texts = checkpointed(_with_text(left.select("id"), docs, id_column, text_column))
    grams = gram_rows(texts, n)
    blocks = connected_components(checkpointed(block_edges(grams, percent)))
    member = checkpointed(blocks.select("id", F.col("component").alias("block")).join(left, "id"))
    stats = member.groupBy("block").agg(
        F.count("*").alias("m"),
        F.sum("n").alias("grams"),
        *[F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id"))).alias(f"p{k}") for k in range(4)],
    )
    stats = stats.filter("m > 1").withColumn("tiles", F.ceil(F.col("grams") / block_grams).cast("int"))
    rows = member.join(stats, "block")
    own = F.when(F.col("tiles") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("tiles"))).cast("int")
    tiled = rows.select("block", "id", own.alias("tile"))
    pivots = (
        stats.filter("tiles > 1")
        .select("block", "tiles", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.id") for k in range(4)]))).alias("id"))
        .select("block", "id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    )
    keys = checkpointed(
        tiled.unionByName(pivots)
        .distinct()
        .select(F.struct("block", "tile", F.lit(0).alias("part")).alias("k"), "id", F.lit(None).cast("long").alias("label"), F.lit(True).alias("wanted"))
        .select(F.concat_ws(":", "k.block", "k.tile", "k.part").alias("key"), "id", "label", "wanted")
    )
    edges = checkpointed(_tiles(_with_text(keys, texts, "id", "text"), n, percent))
    labels = connected_components(edges)
    cut = stats.filter("tiles > 1").select("block", "tiles")
    if not cut.isEmpty():
        edges = edges.unionByName(_between_tiles(member, cut, labels, texts, n, percent, block_grams))
        labels = connected_components(edges)
    return table, texts, labels


def _sets(table: DataFrame) -> DataFrame:
    """Each set once, with its smallest id and how many ids have it."""
    return table.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"))


def jaccard_links(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 5,
    percent: int = 80,
    block_grams: int = 2_000_000,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """``(a, b, overlap)``: every link between different sets, by their smallest ids, ``a < b``.

    Documents of equal sets are not expanded into pairs; ``jaccard_components`` gives what a document belongs to.
    Ids that stand on several different texts are one document, and a link of an id with itself is left out.
    """
    table, texts, labels = _connected(docs, id_column, text_column, n, percent, block_grams, bucket_grams)
    member = checkpointed(_sets(table).join(labels, "id").select("component", "id", "h1", "n", "copies"))
    return _products(checkpointed(_tile_pairs(member, percent, block_grams)), texts, n, percent, False).filter("a < b")


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 5,
    percent: int = 80,
    block_grams: int = 2_000_000,
    bucket_grams: int = BUCKET_GRAMS,
    links: bool = False,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``, with ``links`` also ``n_links``.

    ``component_id`` is the smallest id reachable over links, a document's own id where it has none. ``n_links`` is the number
    of other ids that a document's set links with, those of equal sets included; each set of an id that stands on several different
    texts counts. ``bucket_grams``: counted n-grams that a bucket of the first count is for; it does not change the result.
    """
    table, texts, labels = _connected(docs, id_column, text_column, n, percent, block_grams, bucket_grams)
    sets = _sets(table)
    component = sets.join(labels, "id", "left").select("h1", "h2", "n", "id", "copies", F.coalesce("component", "id").alias("component"))
    if links:
        component = checkpointed(component)
        member = component.join(labels.select("id"), "id", "left_semi").select("component", "id", "h1", "n", "copies")
        found = _products(checkpointed(_tile_pairs(member, percent, block_grams)), texts, n, percent, True)
        component = component.join(found.groupBy("id", "h1").agg(F.sum("links").alias("links")), ["id", "h1"], "left")
    else:
        component = component.withColumn("links", F.lit(None).cast("long"))
    component = component.withColumnRenamed("id", "rep")
    out = table.join(component, ["h1", "h2", "n"], "left")
    given = [F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")]
    if links:
        others = F.col("copies") - F.col("id").isNotNull().cast("long")
        given.append((F.coalesce(others, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"))
    return out.select("id", *given)


def _between_tiles(member, cut, labels, texts, n, percent, block_grams) -> DataFrame:
    """Links between rows outside their block's largest component and all tiles of that block."""
    placed = checkpointed(member.join(cut, "block").join(labels, "id", "left").select("block", "tiles", "id", "n", F.coalesce("component", "id").alias("label")))
    main = (
        placed.groupBy("block", "label").agg(F.count("*").alias("m"))
        .groupBy("block").agg(F.max(F.struct("m", "label")).alias("x"))
        .select("block", F.col("x.label").alias("main"))
    )
    loose = placed.join(main, "block").filter("label <> main").select("block", "tiles", "id", "n", "label")
    parts = loose.groupBy("block").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("parts"))
    loose = loose.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int"))
    asked = loose.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "part", "id", "label", F.lit(True).alias("wanted"))
    there = (
        placed.join(parts, "block")
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .select("block", "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "label", F.lit(False).alias("wanted"))
    )
    keys = (
        asked.unionByName(there)
        .groupBy(F.concat_ws(":", "block", "tile", "part").alias("key"), "id", "label")
        .agg(F.max("wanted").alias("wanted"))
    )
    return checkpointed(_tiles(_with_text(checkpointed(keys), texts, "id", "text"), n, percent))
