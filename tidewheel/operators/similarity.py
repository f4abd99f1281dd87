"""Exact similarity joins: all pairs, one against all, nearest, and pairs of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewheel.functions.vectors import cosine, is_zero, l2, l2_to_cosine, unit
from tidewheel.operators.components import checkpointed

#: Bytes of a block of vectors in single precision, rows and products of it that are made at once, and numbers that are summed again at once.
BLOCK_BYTES, STRIP_ROWS, STRIP_NUMBERS, FOLD_NUMBERS = 8 << 20, 512, 1 << 21, 1 << 20
#: Products are summed in another order by the matrix library, so they only propose pairs.
MARGIN = 1e-6
#: A component's rows that are multiplied with those outside it before it is looked at again, and the share (one in so many) it must hold for that.
JOINED_ROWS, JOINED_SHARE = 2048, 16


def eligible(vectors: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Vectors that take part: no zero vectors, none of the excluded ids (which need not be items)."""
    kept = vectors.filter(~is_zero(F.col("embedding")))
    return kept if excluded is None else kept.join(excluded.select("item_id"), "item_id", "left_anti")


def similar_pairs_reference(vectors: DataFrame, threshold: float) -> DataFrame:
    """The definition, for small tables: every pair by a nested loop."""
    a = vectors.select(F.col("item_id").alias("src"), F.col("embedding").alias("a"))
    b = vectors.select(F.col("item_id").alias("dst"), F.col("embedding").alias("b"))
    return a.join(b, F.col("src") < F.col("dst")).select("src", "dst", cosine(F.col("a"), F.col("b")).alias("sim")).filter(F.col("sim") >= threshold)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs, summed from left to right like the column expression."""
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    product = np.sqrt(aa) * np.sqrt(bb)
    return np.divide(dot, product, out=np.zeros_like(dot), where=product != 0)


def _margin(dims: int) -> float:
    """Twice what a product of unit rows in single precision can differ by from the sum in double precision."""
    return MARGIN + (dims + 8) * 2.0**-23


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Unit rows in single precision, made a strip at a time."""
    out = np.empty(matrix.shape, np.float32)
    for at in range(0, len(matrix), STRIP_ROWS):
        part = matrix[at : at + STRIP_ROWS].astype(np.float64)
        length = np.linalg.norm(part, axis=1)
        out[at : at + STRIP_ROWS] = part / np.where(length == 0, 1, length)[:, None]
    return out


def _strips(left: np.ndarray, right: np.ndarray, same: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of all rows on both sides by the matrix library, a strip of left rows at a time, with its first row.

    ``same``: both are one block, and a strip is multiplied with the rows from its first one on only.
    """
    a = _scaled(left)
    b = a if same else _scaled(right)
    rows = max(1, min(STRIP_ROWS, STRIP_NUMBERS // max(1, len(right))))
    for at in range(0, len(left), rows):
        yield at, a[at : at + rows] @ b[at if same else 0 :].T


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true."""
    return np.divmod(np.flatnonzero(mask.ravel()), max(1, mask.shape[1]))


def _pairs_in(left: np.ndarray, right: np.ndarray, same: bool, keep) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, sim)`` of row pairs whose product ``keep`` lets through, a strip of rows and a few pairs at a time.

    ``same``: both are one block, of which each pair counts once.
    """
    few = max(1, FOLD_NUMBERS // max(1, left.shape[1]))
    for at, sims in _strips(left, right, same):
        if same:
            sims[np.tril_indices(len(sims))] = np.nan
        i, j = _places(keep(sims))
        i, j = i + at, j + (at if same else 0)
        for k in range(0, len(i), few):
            x, y = i[k : k + few], j[k : k + few]
            yield x, y, _fold(left[x], right[y])


def _dealt(rows: DataFrame, keys: list[str], number: Column, others: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` dealt to pairs (p, q) of blocks, p at most q; each task gets whole pairs, one after another."""
    pairs = rows.select(*keys, "item_id", "embedding", *more, number.alias("b"), F.explode(others).alias("o")).select(
        *keys, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "item_id", "embedding", *more
    )
    return pairs.repartition(*keys, "p", "q").sortWithinPartitions(*keys, "p", "q", "b")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Array, np.ndarray, np.ndarray]]:
    """``(key, ids, left, right)`` of each pair of blocks in sorted batches; ids are those of the left rows, then the right ones.

    Rows keep their precision. A block with itself is both left and right, and its ids come once.
    """
    now, names, held, blocks = None, [], [], []

    def done():
        ids, block, matrix = pa.concat_arrays(names), np.concatenate(blocks), np.concatenate(held)
        held.clear()
        if now[-2] == now[-1]:
            return now, ids, matrix, matrix
        cut = int(np.searchsorted(block, now[-1]))  # blocks come in order
        return now, ids, matrix[:cut], matrix[cut:]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        p, q, block = (batch.column(keys + k).to_numpy() for k in range(3))
        lists = batch.column(keys + 4)
        flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)
        more = [batch.column(k).to_pylist() for k in range(keys)]
        other = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        for column in more:
            other |= np.fromiter((x != y for x, y in zip(column[1:], column, strict=False)), bool, n - 1)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = (*(column[a] for column in more), int(p[a]), int(q[a]))
            if key != now:
                if now is not None:
                    yield done()
                now, names, held, blocks = key, [], [], []
            names.append(batch.column(keys + 3).slice(a, z - a))
            blocks.append(block[a:z].copy())
            held.append(flat[a:z].copy())
    if now is not None:
        yield done()


def _block_count(vectors: DataFrame, block_rows: int | None) -> int:
    """Blocks of bounded bytes, and enough of them for all cores where there are vectors enough."""
    first = vectors.select(F.size("embedding")).first()
    n = vectors.count()
    rows = block_rows or max(1, BLOCK_BYTES // (4 * max(1, first[0] if first else 1)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // rows), 1 if block_rows else min(-(-n // 256), int((2 * cores) ** 0.5) + 1))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``rep``, the smallest id that has an equal vector.

    Vectors meet by two hashes of 64 bits; only those whose hashes occur twice are compared themselves.
    """
    # what the vectors come from, often a join, is read once instead of at every step
    hashed = checkpointed(vectors.select("item_id", "embedding")).select("item_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    often = checkpointed(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"))
    twice = hashed.join(often, ["h1", "h2"], "left_semi")
    first = twice.groupBy("h1", "h2", "embedding").agg(F.min("item_id").alias("rep"))
    again = twice.join(first, ["h1", "h2", "embedding"]).select("item_id", "embedding", "rep")
    return hashed.join(often, ["h1", "h2"], "left_anti").select("item_id", "embedding", F.col("item_id").alias("rep")).unionByName(again)


def _classed(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``rep``, as they came if they have it."""
    return vectors if "rep" in vectors.columns else vector_classes(vectors)


class _Joined:
    """What pairs have joined so far: a number for each left and right row, equal where a chain of pairs connects two."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        """``left``, ``right``: values that are equal where rows are connected from the start."""
        values, first = np.unique(np.concatenate([left, right]), return_inverse=True)
        self.own = first[: len(left)], first[len(left) :]
        self.root = np.arange(len(values))
        self.now = self.own

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.now[0][i] != self.now[1][j]

    def add(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Join pairs; which of them joined what was not connected."""
        root, kept = self.root.tolist(), []
        for k, (x, y) in enumerate(zip(self.now[0][i].tolist(), self.now[1][j].tolist(), strict=True)):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[y] = x
                kept.append(k)
        if kept:
            self.root = np.array(root)
            while (higher := self.root[self.root])[self.root != higher].size:
                self.root = higher
            self.now = self.root[self.own[0]], self.root[self.own[1]]
        return kept


def pairs_of_blocks(dealt: DataFrame, threshold: float, spanning: bool = False) -> DataFrame:
    """``(src, dst, sim)`` of the pairs at or over a threshold in each pair of dealt blocks; with ``spanning`` only a forest of them.

    With a column ``label`` rows of one label are taken as connected, and the forest is between labels; an edge comes with both
    labels, ``a`` and ``b``. Without, it comes with ``root``, the smallest id that its blocks connect it with.
    """
    labelled = spanning and "label" in dealt.columns
    if labelled:
        named = F.struct("item_id", "label")
        dealt = dealt.select("p", "q", "b", named.alias("item_id"), "embedding")

    more = ["a", "b"] if labelled else ["root"] if spanning else []

    def run(batches):
        for (p, q), names, left, right in _groups(batches, 0):
            if not len(left) or not len(right):
                continue
            ids, at = names.field(0) if labelled else names, len(left) if p != q else 0
            if not spanning:
                margin = _margin(left.shape[1])
                for i, j, sim in _pairs_in(left, right, p == q, lambda sims, least=threshold - margin: sims >= least):
                    good = sim >= threshold
                    if good.any():
                        yield _edges(ids.take(pa.array(i[good])), ids.take(pa.array(j[good] + at)), sim[good])
                continue
            codes = (names.field(1) if labelled else names).dictionary_encode()
            labels = codes.indices.to_numpy()
            joined = _Joined(labels[: len(left)], labels[at : at + len(right)])
            found = [x for x in _forest_in(left, right, p == q, threshold, joined) if len(x[0])]
            if not found:
                continue
            i, j, sim = (np.concatenate(x) for x in zip(*found, strict=True))
            x, y = ids.take(pa.array(i)), ids.take(pa.array(j + at))
            if labelled:
                held = [names.field(1).take(pa.array(i)), names.field(1).take(pa.array(j + at))]
            else:
                held = [_roots(joined.now[0][i], x, y)]
            yield _edges(x, y, sim, dict(zip(more, held, strict=True)))

    return dealt.mapInArrow(run, "src string, dst string, sim double" + "".join(f", {c} string" for c in more))


def _edges(x: pa.Array, y: pa.Array, sim: np.ndarray, more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """A batch of edges, the smaller id first."""
    low = pc.less(x, y)
    return pa.RecordBatch.from_pydict({"src": pc.if_else(low, x, y), "dst": pc.if_else(low, y, x), "sim": pa.array(sim), **(more or {})})


def _roots(number: np.ndarray, x: pa.Array, y: pa.Array) -> pa.Array:
    """The smallest id of each edge's component; ``number`` tells the component."""
    table = pa.table({"number": number, "low": pc.min_element_wise(x, y)}).group_by("number").aggregate([("low", "min")])
    places = pc.index_in(pa.array(number), value_set=table["number"].combine_chunks())
    return table["low_min"].combine_chunks().take(places)


def _forest_in(left: np.ndarray, right: np.ndarray, same: bool, threshold: float, joined: _Joined) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, sim)`` of pairs that join what was not connected, until everything similar is.

    Rows of a component that already holds a good share are multiplied only with the rows that it does not hold.
    """
    a = _scaled(left)
    b = a if same else _scaled(right)
    least, few = threshold - _margin(left.shape[1]), max(1, FOLD_NUMBERS // max(1, left.shape[1]))
    todo, waiting = np.arange(len(left)), np.ones(len(right), bool)
    while len(todo):
        of_left, of_right = joined.now
        most = np.bincount(of_left[todo]).argmax()
        held = waiting & (of_right == most)
        columns, rows = np.flatnonzero(waiting & ~held), todo[of_left[todo] == most]
        if JOINED_SHARE * np.count_nonzero(held) >= np.count_nonzero(waiting):
            rows = rows[:JOINED_ROWS] if len(columns) else rows
        else:
            columns = np.flatnonzero(waiting)
            rows = todo[: max(1, min(STRIP_ROWS, STRIP_NUMBERS // len(columns)))]
        with_ = (b if len(columns) == len(b) else b[columns]).T
        step = max(1, STRIP_NUMBERS // max(1, len(columns)))
        for at in range(0, len(rows) if len(columns) else 0, step):
            i, j = _places(a[rows[at : at + step]] @ with_ >= least)
            for k in range(0, len(i), few):
                x, y = rows[at + i[k : k + few]], columns[j[k : k + few]]
                apart = joined.apart(x, y)
                x, y = x[apart], y[apart]
                if len(x):
                    sim = _fold(left[x], right[y])
                    good = np.flatnonzero(sim >= threshold)
                    good = good[joined.add(x[good], y[good])]
                    yield x[good], y[good], sim[good]
        done = np.zeros(len(left), bool)
        done[rows] = True
        todo = todo[~done[todo]]
        if same:  # a pair counts once
            waiting[rows] = False


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int | None = None, spanning: bool = False) -> DataFrame:
    """``(src, dst, sim)`` with src < dst and cosine >= threshold, of different vectors, by products of blocks.

    Equal vectors are one vertex, their smallest id (see ``vector_classes``; a ``rep`` column is taken as that): what the
    smallest is similar to, the others are too. Each pair of blocks is one task's product, taken in strips, and its
    pairs are summed again a few at a time, so a task's memory is two blocks whatever is similar. Every vector goes to
    every block; ``metric.pruned_pairs`` sends it only where its neighbours can be. With ``spanning`` a block pair gives
    a forest of its pairs, which connects what all of them connect.
    """
    different = checkpointed(_classed(vectors).filter("item_id = rep").select("item_id", "embedding"))
    blocks = _block_count(different, block_rows)
    dealt = _dealt(different, [], F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(blocks - 1)))
    return pairs_of_blocks(dealt, threshold, spanning).select("src", "dst", "sim")


def copy_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges of each copy with the first of its equals."""
    self = cosine(F.col("embedding"), F.col("embedding"))
    return classes.filter("rep <> item_id").select(F.col("rep").alias("src"), F.col("item_id").alias("dst"), self.alias("sim")).filter(F.col("sim") >= threshold)


def similar_edges(vectors: DataFrame, threshold: float, spanning: bool = False) -> DataFrame:
    """Edges that connect what all similar pairs connect: those of different vectors, and each copy with its first.

    With ``spanning`` every pair of blocks gives a forest; ``forest.joining_edges`` gives fewer edges yet.
    """
    classes = vectors if "rep" in vectors.columns else checkpointed(vector_classes(vectors))
    return similar_pairs(classes, threshold, spanning=spanning).unionByName(copy_edges(classes, threshold))


def _dealt_across(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Asked and stored vectors dealt to pairs of a block of each."""
    a, b = _block_count(asked, None), _block_count(stored, None)
    number = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    ask = asked.select("item_id", "embedding", number(a).alias("n"), F.sequence(F.lit(a), F.lit(a + b - 1)).alias("others"))
    hold = stored.select("item_id", "embedding", (number(b) + a).alias("n"), F.sequence(F.lit(0), F.lit(a - 1)).alias("others"))
    return _dealt(ask.unionByName(hold), [], F.col("n"), F.col("others"))


def touching(asked: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """``item_id`` of each asked vector that any stored one is similar to; both are ``(item_id, embedding)``."""

    def run(batches):
        for _, names, left, right in _groups(batches, 0):
            if not len(left) or not len(right):
                continue
            found, margin = np.zeros(len(left), bool), _margin(left.shape[1])
            for at, sims in _strips(left, right):
                best = sims.max(axis=1)
                found[at : at + len(sims)] = best >= threshold + margin
                # near the threshold the sum from left to right decides
                few = max(1, FOLD_NUMBERS // max(1, left.shape[1]))
                for k in np.flatnonzero((best >= threshold - margin) & (best < threshold + margin)):
                    close = np.flatnonzero(sims[k] >= threshold - margin)
                    found[at + k] = any((_fold(left[[at + k]], right[close[c : c + few]]) >= threshold).any() for c in range(0, len(close), few))
            if found.any():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.flatnonzero(found)))], ["item_id"])

    return _dealt_across(asked, stored).mapInArrow(run, "item_id string").distinct()


def matches_of_blocks(dealt: DataFrame, threshold: float) -> DataFrame:
    """``(item_id, match, sim)`` of the left and right vectors at or over a threshold in each pair of dealt blocks."""

    def run(batches):
        for _, names, left, right in _groups(batches, 0):
            if not len(left) or not len(right):
                continue
            least = threshold - _margin(left.shape[1])
            for i, j, sim in _pairs_in(left, right, False, lambda sims, least=least: sims >= least):
                good = sim >= threshold
                if good.any():
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i[good])), names.take(pa.array(j[good] + len(left))), pa.array(sim[good])], ["item_id", "match", "sim"])

    return dealt.mapInArrow(run, "item_id string, match string, sim double")


def cross_pairs(asked: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """``(item_id, match, sim)`` of each asked vector and each stored one with cosine >= threshold, block by block.

    Neither side is sent whole to a task. Both are ``(item_id, embedding)``; an id may be on both sides.
    """
    return matches_of_blocks(_dealt_across(asked, stored), threshold)


def one_against_all(vectors: DataFrame, query: list[float], threshold: float, skip: str | None = None) -> DataFrame:
    """``(item_id, sim)`` of stored vectors at or over a threshold with one vector; no shuffle."""
    kept = eligible(vectors) if skip is None else eligible(vectors).filter(F.col("item_id") != skip)
    sim = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return kept.select("item_id", sim.alias("sim")).filter(F.col("sim") >= threshold)


def nearest(vectors: DataFrame, query: list[float], k: int = 20, threshold: float = 0.0) -> DataFrame:
    """The ``k`` nearest by Euclidean distance of unit vectors; the threshold applies after the limit."""
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    top = vectors.select("item_id", l2(unit(F.col("embedding")), q).alias("distance")).orderBy("distance", "item_id").limit(k)
    return top.filter(l2_to_cosine(F.col("distance")) >= threshold)


def compare(vectors: DataFrame, first: str, second: str) -> DataFrame:
    """Similarity and verdict of two items; no row where one is missing or zero."""
    kept = vectors.filter(F.col("item_id").isin(first, second) & ~is_zero(F.col("embedding")))
    a = kept.filter(F.col("item_id") == first).select(F.lit(1).alias("k"), F.col("item_id").alias("first"), F.col("embedding").alias("a"))
    b = kept.filter(F.col("item_id") == second).select(F.lit(1).alias("k"), F.col("item_id").alias("second"), F.col("embedding").alias("b"))
    sim = cosine(F.col("a"), F.col("b"))
    return a.join(b, "k").select("first", "second", sim.alias("sim")).withColumn("verdict", verdict(F.col("sim")))


def verdict(sim):
    return F.when(sim >= 0.85, "likely duplicates").when(sim >= 0.65, "related").otherwise("unrelated")


def best_section(vectors: DataFrame, sections: DataFrame, aligned: float = 0.65, drifting: float = 0.4) -> DataFrame:
    """Each item's best section, strictly above 0 and the first among equals, and its class.

    ``sections`` (idx, heading, embedding) is one document's outline: its rows are counted before they are sent
    to every task as one matrix. Scores near the best are summed again from left to right.
    """
    if (n := sections.count()) > 10_000:
        raise ValueError(f"{n} sections are not an outline")
    rows = sections.orderBy("idx").select("idx", "heading", F.col("embedding").cast("array<double>").alias("embedding")).collect()
    outline = np.array([r["embedding"] for r in rows], np.float64)
    headings = [r["heading"] for r in rows]
    length = np.linalg.norm(outline, axis=1) if rows else np.zeros(0)
    scaled = outline / np.where(length == 0, 1, length)[:, None] if rows else outline

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score, place = np.zeros(batch.num_rows), np.full(batch.num_rows, -1)
            if headings:
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if matrix.shape[1] != outline.shape[1]:
                    raise ValueError("vectors differ in length")
                for at in range(0, len(matrix), STRIP_ROWS):
                    part = matrix[at : at + STRIP_ROWS]
                    sims = (part / np.linalg.norm(part, axis=1)[:, None]) @ scaled.T
                    i, j = np.nonzero(sims >= sims.max(axis=1)[:, None] - MARGIN)
                    few = max(1, FOLD_NUMBERS // matrix.shape[1])
                    exact = np.concatenate([_fold(part[i[k : k + few]], outline[j[k : k + few]]) for k in range(0, len(i), few)])
                    # the greatest, then the first
                    order = np.lexsort((j, -exact, i))
                    first = order[np.append(True, i[order][1:] != i[order][:-1])]
                    score[at + i[first]], place[at + i[first]] = exact[first], j[first]
            section = [headings[j] if s > 0 else "" for s, j in zip(score.tolist(), place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(score, 0.0)), pa.array(section, pa.string())], ["item_id", "score", "section"])

    kept = vectors.filter(~is_zero(F.col("embedding"))).select("item_id", F.col("embedding").cast("array<double>").alias("embedding"))
    score = F.col("score")
    label = F.when(score >= aligned, "aligned").when(score >= drifting, "drifting").otherwise("off-vision")
    return kept.mapInArrow(run, "item_id string, score double, section string").select("item_id", "score", label.alias("classification"), "section")


def vector_sums(rows: DataFrame, key: str, scaled: bool = False) -> DataFrame:
    """``(key, n, total, squares)``: count, sum of the vectors in doubles and sum of their squared lengths; ``scaled``: of unit vectors.

    A task adds what it has of a key and sends one row, so a key of any size is a row a task when it is added up.
    """
    kind, key_type = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    ddl = f"{key} {kind}, n bigint, total array<double>, squares double"
    given = rows.select(key, F.lit(1).cast("bigint").alias("n"), F.col("embedding").cast("array<double>").alias("total"), F.lit(0.0).alias("squares"))

    def add(batches, first: bool):
        held: dict = {}

        def out():
            if held:
                n, total, squares = zip(*held.values(), strict=True)
                arrow = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, total)]), pa.int32()), pa.array(np.concatenate(total)))
                yield pa.RecordBatch.from_arrays([pa.array(list(held), key_type), pa.array(n, pa.int64()), arrow, pa.array(squares, pa.float64())], [key, "n", "total", "squares"])

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            squares = batch.column(3).to_numpy()
            if first:
                squares = (matrix * matrix).sum(axis=1)
                if scaled:
                    length = np.sqrt(squares)
                    matrix, squares = matrix / np.where(length == 0, 1, length)[:, None], (length > 0).astype(float)
            names, place = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            total, counts = np.zeros((len(names), matrix.shape[1])), np.zeros(len(names), np.int64)
            np.add.at(total, place, matrix)
            np.add.at(counts, place, batch.column(1).to_numpy())
            sums = np.bincount(place, squares, len(names))
            for i, name in enumerate(names):
                a, b, c = held.get(name, (0, 0.0, 0.0))
                held[name] = (a + int(counts[i]), b + total[i], c + float(sums[i]))
            if len(held) * matrix.shape[1] * 8 > BLOCK_BYTES and first:
                yield from out()
                held.clear()
        yield from out()

    parts = given.mapInArrow(lambda batches: add(batches, True), ddl)

    def whole(batches):
        """Rows in the order of keys: one key is held at a time."""
        last = None
        for batch in batches:
            matrix = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            done = []
            for i, (name, n, squares) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last is not None and last[0] == name:
                    last = (name, last[1] + n, last[2] + matrix[i], last[3] + squares)
                else:
                    done += [] if last is None else [last]
                    last = (name, n, matrix[i], squares)
            yield from made(done)
        yield from made([] if last is None else [last])

    def made(rows_):
        if rows_:
            names, n, total, squares = zip(*rows_, strict=True)
            arrow = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, total)]), pa.int32()), pa.array(np.concatenate(total)))
            yield pa.RecordBatch.from_arrays([pa.array(names, key_type), pa.array(n, pa.int64()), arrow, pa.array(squares, pa.float64())], [key, "n", "total", "squares"])

    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(whole, ddl)


#: Bands of angle in which the rows of a cluster of more than one block lie, and what rounding can make of an angle at most.
BANDS, ANGLE_SLACK = 32, 1e-5


def _angle(a: Column, b: Column) -> Column:
    """Angle of two vectors; half a turn, which bounds all, where one of them is zero."""
    sim = cosine(a, b)
    return F.when(is_zero(a) | is_zero(b), np.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim))))


def _far_rows(rows: DataFrame, centres: DataFrame, sent: bool = False) -> tuple[DataFrame, DataFrame]:
    """Which rows of each cluster may be in a pair that is less similar than one already found, and what was found.

    ``rows`` (cluster_key, item_id, embedding), ``centres`` (cluster_key, most, total). An angle between two rows is at most
    the sum of their angles to the centre. Three sweeps give a pair that is far apart: from the row farthest from the
    centre to what is least similar to it, and on from there. Rows whose angle, with the widest of the cluster, falls short of
    that pair's are left out: ``(cluster_key, item_id, embedding, most, angle, reach, widest)`` and ``(cluster_key, low)``.
    ``sent``: the clusters are few enough to send to every task a row of each.
    """
    of = F.broadcast if sent else lambda df: df
    seen = checkpointed(rows.join(of(centres), "cluster_key").withColumn("angle", _angle(F.col("embedding"), F.col("total"))).drop("total"))
    row = F.struct("item_id", "embedding")
    ends = seen.groupBy("cluster_key").agg(F.max_by(row, F.struct("angle", "item_id")).alias("end"), F.max("angle").alias("widest"))
    known = checkpointed(ends.withColumn("low", F.lit(1.0)))
    for _ in range(2):
        sims = seen.join(of(known), "cluster_key").filter("item_id <> end.item_id").withColumn("sim", cosine(F.col("embedding"), F.col("end.embedding")))
        next_ = F.min_by(row, F.struct("sim", "item_id")).alias("end")
        known = checkpointed(sims.groupBy("cluster_key").agg(next_, F.first("widest").alias("widest"), F.least(F.first("low"), F.min("sim")).alias("low")))
    reach = F.acos(F.greatest(F.lit(-1.0), F.col("low"))) - ANGLE_SLACK
    far = seen.join(of(known.select("cluster_key", "widest", reach.alias("reach"))), "cluster_key").filter(F.col("angle") + F.col("widest") >= F.col("reach"))
    return far, known.select("cluster_key", "low")


def _banded(far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``far`` with its ``band`` of angle, and each cluster's bands that hold rows: their number, widest angle, blocks and first block."""
    least = F.col("reach") - F.col("widest")
    part = F.floor((F.col("angle") - least) / F.nullif(F.col("widest") - least, F.lit(0.0)) * BANDS)
    placed = checkpointed(far.withColumn("band", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), part)), F.lit(0)).cast("int")))
    counted = placed.groupBy("cluster_key", "band").agg(
        F.count("*").alias("n"), F.max("angle").alias("top"), F.ceil(F.count("*") / F.max("most")).cast("int").alias("blocks"), F.max("reach").alias("reach")
    )
    before = Window.partitionBy("cluster_key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return placed, checkpointed(counted.withColumn("offset", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")))


def _dealt_far(far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Far rows dealt to the pairs of blocks that their bands' widest angles let reach, and the bands."""
    placed, bands = _banded(far)
    other = bands.select("cluster_key", F.col("top").alias("t"), F.col("offset").alias("o"), F.col("blocks").alias("m"))
    reached = bands.join(other, "cluster_key").filter(F.col("top") + F.col("t") >= F.col("reach"))
    lists = reached.groupBy("cluster_key", "band", "offset", "blocks").agg(F.flatten(F.collect_list(F.sequence(F.col("o"), F.col("o") + F.col("m") - 1))).alias("others"))
    number = F.col("offset") + F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int")
    return _dealt(placed.join(lists, ["cluster_key", "band"]), ["cluster_key"], number, F.col("others")), bands


def far_work(bands: DataFrame) -> DataFrame:
    """``(cluster_key, rows, pairs)``: rows that were kept of each large cluster, and pairs of them that were multiplied."""
    a, b = (bands.select("cluster_key", *[F.col(c).alias(f"{x}_{c}") for c in ("band", "n", "top", "reach")]) for x in "ab")
    met = F.when(F.col("a_top") + F.col("b_top") >= F.col("a_reach"), F.when(F.col("a_band") == F.col("b_band"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")))
    pairs = a.join(b, "cluster_key").filter("a_band <= b_band").groupBy("cluster_key").agg(F.coalesce(F.sum(met), F.lit(0)).cast("bigint").alias("pairs"))
    return bands.groupBy("cluster_key").agg(F.sum("n").alias("rows")).join(pairs, "cluster_key")


def _lows(dealt: DataFrame, kind: str) -> DataFrame:
    """``(cluster_key, low)``: the least cosine in each pair of dealt blocks, null where there is no pair."""
    key_type = to_arrow_type(dealt.schema["cluster_key"].dataType)

    def run(batches):
        for (key, p, q), _, left, right in _groups(batches, 1):
            least, margin = [np.inf], 2 * _margin(left.shape[1])

            def near(sims, least=least, margin=margin):
                """What may be the minimum so far."""
                if not sims.size or np.isnan(sims).all():
                    return np.zeros(sims.shape, bool)
                least[0] = min(least[0], np.nanmin(sims) + margin)
                return sims <= least[0]

            low = min((sim.min() for _, _, sim in _pairs_in(left, right, p == q, near)), default=None)
            yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([low], pa.float64())], ["cluster_key", "low"])

    return dealt.mapInArrow(run, f"cluster_key {kind}, low double")


def pair_statistics(members: DataFrame, vectors: DataFrame, block_rows: int | None = None, enough: float | None = None) -> DataFrame:
    """Mean and minimum cosine over all pairs of each cluster; the minimum starts at 1.

    With ``enough`` a minimum under it need not be exact: a large cluster of which a pair under it is known is not searched on.

    The mean comes from the sum of the unit vectors, in one pass. The minimum needs pairs, of different vectors only. A
    cluster of one block is multiplied as it is. Of a larger one only rows far enough from its centre are (``_far_rows``), in
    blocks by bands of angle, and only those pairs of blocks whose angles reach; no task holds more than two blocks.
    ``vectors`` may have ``rep``.
    """
    held = _classed(vectors).select("item_id", "rep", "embedding")
    rows = checkpointed(members.select("cluster_key", "item_id").join(held, "item_id"))
    sums = checkpointed(vector_sums(rows, "cluster_key", scaled=True))
    twice = F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x) - F.col("squares")
    mean = sums.select("cluster_key", F.when(F.col("n") > 1, twice / (F.col("n") * (F.col("n") - 1))).alias("avg_similarity"))
    firsts = rows.groupBy("cluster_key", "rep").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    different = rows.drop("rep").join(firsts, ["cluster_key", "item_id"])
    alike = different.filter("copies > 1").groupBy("cluster_key").agg(F.min(cosine(F.col("embedding"), F.col("embedding"))).alias("low"))
    most = F.lit(block_rows) if block_rows else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (4 * F.size("embedding"))).cast("int"))
    sizes = checkpointed(different.groupBy("cluster_key").agg(F.max(most).alias("most"), F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")))
    kind = members.schema["cluster_key"].dataType.simpleString()
    small = different.join(sizes.filter("n <= most"), "cluster_key")
    lows = _lows(_dealt(small, ["cluster_key"], F.lit(0), F.array(F.lit(0))), kind).unionByName(alike)
    large = sizes.filter("n > most").select("cluster_key", "most", "dims")
    held = large.agg(F.count("*").alias("n"), F.sum(F.col("dims") * 8 + 100).alias("bytes")).first()
    if held["n"]:
        centres = large.join(sums, "cluster_key").select("cluster_key", "most", "total")
        far, known = _far_rows(different.select("cluster_key", "item_id", "embedding"), centres, held["bytes"] <= BLOCK_BYTES)
        if enough is not None:
            far = far.join(known.filter(F.col("low") >= enough).select("cluster_key"), "cluster_key", "left_semi")
        lows = lows.unionByName(known).unionByName(_lows(_dealt_far(far)[0], kind))
    lows = lows.groupBy("cluster_key").agg(F.least(F.lit(1.0), F.min("low")).alias("min_similarity"))
    return mean.join(lows, "cluster_key").select("cluster_key", "avg_similarity", "min_similarity")
