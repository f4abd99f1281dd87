"""Centroid clustering (Lloyd's rounds) by kd-tree filtering, in exact integers (Kanungo et al. 2002).

Each partition packs its vectors into trees of bounded size, once. A node holds how many vectors it has, their
integer sum and sum of squares, and their box. In a round the centroids go down every tree: one that is strictly farther
than another from every point of a node's box is pruned there, a node with one centroid left is assigned whole, and
leaves that still have several are resolved vector by vector. A round's result is a count and a sum a centroid
and task; only those ``k`` sums come to the driver.

Vectors are kept that have exactly ``dims`` components, none null, NaN or infinite; each component x becomes
``floor(scale * x)``. Kept vectors of equal id are vectors of their own. Null ids are kept and hash like an empty one.
Components over 2**26 in size are refused, as squared distances of them may pass 64 bits. Where fewer than ``k``
vectors are kept there are fewer centroids; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm._text import released, small_batches
from tidewheel.operators.components import checkpointed

#: Vectors of a tree, and of a leaf.
TREE_ROWS, LEAF_ROWS = 16_384, 32
#: Largest component by size.
LARGEST = 1 << 26
#: Below this, sums of products are whole numbers that a double holds.
_EXACT = 1 << 53
_FIELDS = ("points", "start", "end", "left", "low", "high", "sums", "squares")
_TREE_DDL = "n int, dims int, kind string, ids binary, known binary, " + ", ".join(f"{f} binary" for f in _FIELDS)


@dataclass
class Tree:
    """A kd-tree over ``points`` (int64, in tree order). Children of node i are ``left[i]`` and ``left[i] + 1``; 0: a leaf."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray  # two columns: upper and lower halves


def _halves(squares: np.ndarray) -> list[int]:
    """The sums of the upper and of the lower 32 bits: neither passes 64 bits over a tree."""
    return [int((squares >> 32).sum()), int((squares & 0xFFFFFFFF).sum())]


def build(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
    """The tree over the rows of ``points``, and the order in which it holds them. Nodes are split at the median of their widest side."""
    order = np.arange(len(points))
    start, end, left = [0], [len(points)], [0]
    at = 0
    while at < len(start):
        a, z = start[at], end[at]
        if z - a > leaf:
            part = points[order[a:z]]
            side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            middle = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, side], middle)]
            left[at] = len(start)
            start += [a, a + middle]
            end += [a + middle, z]
            left += [0, 0]
        at += 1
    held = points[order]
    start, end, left = np.array(start), np.array(end), np.array(left)
    low, high, sums = (np.zeros((len(start), points.shape[1]), np.int64) for _ in range(3))
    squares = np.zeros((len(start), 2), np.int64)
    for i in range(len(start) - 1, -1, -1):  # children stand behind their parents
        if left[i]:
            a, b = left[i], left[i] + 1
            low[i], high[i] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
            sums[i], squares[i] = sums[a] + sums[b], squares[a] + squares[b]
        elif end[i] > start[i]:
            part = held[start[i] : end[i]]
            low[i], high[i], sums[i], squares[i] = part.min(axis=0), part.max(axis=0), part.sum(axis=0), _halves((part * part).sum(axis=1))
    return Tree(held, start, end, left, low, high, sums, squares), order


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in exact integers; by doubles where every partial sum is a whole number that they hold."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < _EXACT else a @ b.T


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * _product(points, centroids) + (centroids * centroids).sum(axis=1)


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which live centroids of each node are strictly farther than another live one from every point of the node's box.

    The other one is the live centroid nearest to the box's middle. Of all points of the box, the corner that lies
    farthest in the direction from it to z favours z most; if even that corner is strictly nearer to the other
    one, every point is.
    """
    middle = low + high  # twice the middle
    away = np.where(alive, distances(middle, 2 * centroids), np.iinfo(np.int64).max)
    best = centroids[np.argmin(away, axis=1)]
    out = np.zeros(alive.shape, bool)
    for z in range(len(centroids)):
        way = centroids[z] - best
        corner = np.where(way > 0, high, low)
        out[:, z] = (way * (centroids[z] + best - 2 * corner)).sum(axis=1) > 0
    return out & alive


def assign(tree: Tree, centroids: np.ndarray) -> tuple[list, list, np.ndarray]:
    """``(nodes, owners, resolved)``: whole nodes with their centroids, and rows ``(row, centroid)`` of leaves resolved exactly.

    All nodes of a level are filtered together. Equal distances go to the smaller number: strict domination never drops it.
    """
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    whole, owners, rows, near = [], [], [], []
    while len(nodes):
        alive &= ~dominated(tree.low[nodes], tree.high[nodes], centroids, alive)
        single = alive.sum(axis=1) == 1
        whole.append(nodes[single])
        owners.append(np.argmax(alive[single], axis=1))
        inner = ~single & (tree.left[nodes] > 0)
        for node, live in zip(nodes[~single & ~inner], alive[~single & ~inner], strict=True):
            some = np.flatnonzero(live)
            a, z = tree.start[node], tree.end[node]
            rows.append(np.arange(a, z))
            near.append(some[np.argmin(distances(tree.points[a:z], centroids[some]), axis=1)])
        below = tree.left[nodes[inner]]
        nodes, alive = np.concatenate([below, below + 1]), np.concatenate([alive[inner], alive[inner]])
    resolved = np.array([np.concatenate(rows), np.concatenate(near)]) if rows else np.zeros((2, 0), np.int64)
    return np.concatenate(whole), np.concatenate(owners), resolved


def _totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Count, sum and sum of squares of each centroid's vectors, from whole nodes and resolved rows; how many were resolved singly."""
    nodes, owners, (rows, near) = assign(tree, centroids)
    n, squares = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), 2), np.int64)
    sums = np.zeros(centroids.shape, np.int64)
    np.add.at(n, owners, (tree.end - tree.start)[nodes])
    np.add.at(sums, owners, tree.sums[nodes])
    np.add.at(squares, owners, tree.squares[nodes])
    points = tree.points[rows]
    np.add.at(n, near, 1)
    np.add.at(sums, near, points)
    own = (points * points).sum(axis=1)
    np.add.at(squares, near, np.stack([own >> 32, own & 0xFFFFFFFF], axis=1))
    return n, sums, squares.astype(object) @ np.array([1 << 32, 1], object), len(rows)


def _packed(tree: Tree, ids: pa.Array, dims: int) -> pa.RecordBatch:
    most = int(np.abs(tree.points).max(initial=0))
    kind = next(k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max)
    fields = [tree.points.astype(kind), *(getattr(tree, f).astype(kind if f in ("low", "high") else np.int64) for f in _FIELDS[1:])]
    known = np.asarray(ids.is_valid())
    values = [pa.array([len(ids)], pa.int32()), pa.array([dims], pa.int32()), pa.array([kind])]
    values += [pa.array([x.tobytes()], pa.binary()) for x in (ids.fill_null(0).to_numpy().astype(np.int64), known, *fields)]
    return pa.RecordBatch.from_arrays(values, ["n", "dims", "kind", "ids", "known", *_FIELDS])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            kind, dims = row["kind"].as_py(), row["dims"].as_py()
            read = {f: np.frombuffer(row[f].as_buffer(), kind if f in ("points", "low", "high") else np.int64) for f in _FIELDS}
            for f in ("points", "low", "high", "sums", "squares"):
                read[f] = read[f].astype(np.int64).reshape(-1, 2 if f == "squares" else dims)
            yield Tree(**read), np.frombuffer(row["ids"].as_buffer(), np.int64), np.frombuffer(row["known"].as_buffer(), bool)


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part, ``v`` in integers."""
    v = F.col(vector_column)
    fits = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) <= LARGEST, y).otherwise(F.raise_error(F.lit(f"a component passes {LARGEST} in size")).cast("bigint"))

    return vectors.filter(v.isNotNull() & fits).select(F.col(id_column).cast("bigint").alias("id"), F.transform(v, whole).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id`` in ascending order; repeated ids by their vectors. ``k`` rows come to the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def plant(kept: DataFrame, dims: int, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Trees of at most ``tree_rows`` vectors of a partition each, one row a tree."""

    def run(batches):
        held, ids, n = [], [], 0

        def made():
            points, names = np.concatenate(held), pa.concat_arrays(ids)
            tree, order = build(points, leaf_rows)
            return _packed(tree, names.take(pa.array(order)), dims)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tree_rows - n)
                lists = part.column(1)
                held.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                ids.append(part.column(0))
                n, at = n + part.num_rows, at + part.num_rows
                if n == tree_rows:
                    yield made()
                    held, ids, n = [], [], 0
        if n:
            yield made()

    return small_batches(kept).mapInArrow(released(run), _TREE_DDL)


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """``{centroid: (count, sums, sum of squares)}`` of a round: one row a centroid and task, added up exactly by Spark."""

    def run(batches):
        n, squares, sums, any_ = np.zeros(len(centroids), object), np.zeros(len(centroids), object), np.zeros(centroids.shape, object), False
        for tree, _, _ in _trees(batches):
            a, b, c, _ = _totals(tree, centroids)
            n, sums, squares, any_ = n + a, sums + b, squares + c, True
        if any_:
            # place -2 has the count, -1 the sum of squares
            values = np.concatenate([n[:, None], squares[:, None], sums], axis=1)
            k, d = np.indices(values.shape)
            text = pa.array([str(x) for x in values.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(d.ravel() - 2, pa.int32()), text], ["k", "d", "x"])

    added = trees.mapInArrow(run, "k int, d int, x string").groupBy("k", "d").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x"))
    found: dict = {}
    for r in added.collect():  # k * (dims + 2) rows
        found.setdefault(r["k"], {})[r["d"]] = int(r["x"])
    return {k: (x[-2], [x[d] for d in range(centroids.shape[1])], x[-1]) for k, x in found.items()}


def clusters(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tree_rows: int = TREE_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` of every kept vector after ``rounds`` rounds.

    ``distance`` is squared, ``centroid`` the final centroid's integers. Inertias that pass 64 bits are null.
    """
    kept = kept_vectors(vectors, dims, scale, id_column, vector_column)
    centroids = first_centroids(kept, k, seed)
    ddl = "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], ddl)
    trees = checkpointed(plant(kept, dims, tree_rows, leaf_rows))
    for _ in range(rounds):
        for c, (n, sums, _) in totals(trees, centroids).items():
            if n:
                centroids[c] = [x // n for x in sums]
    inertia = {}
    for c, (n, sums, squares) in totals(trees, centroids).items():
        own = [int(x) for x in centroids[c]]
        inertia[c] = squares - 2 * sum(x * y for x, y in zip(own, sums, strict=True)) + n * sum(x * x for x in own)
    known = lambda x: x if x < 1 << 63 else None

    def run(batches):
        for tree, ids, valid in _trees(batches):
            nodes, owners, (rows, near) = assign(tree, centroids)
            cluster = np.zeros(len(ids), np.int32)
            for node, owner in zip(nodes, owners, strict=True):
                cluster[tree.start[node] : tree.end[node]] = owner
            cluster[rows] = near
            away = tree.points - centroids[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(cluster), pa.array((away * away).sum(axis=1))], ["id", "cluster", "distance"])

    heads = [(c, known(x), known(sum(inertia.values())), [int(y) for y in centroids[c]]) for c, x in inertia.items()]
    named = vectors.sparkSession.createDataFrame(heads, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    found = trees.mapInArrow(released(run), "id bigint, cluster int, distance bigint")
    return found.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def _round(centroids: str, name: str) -> str:
    return f"""
{name}_near AS (SELECT v.row, arg_min(c.k, (v.vv - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c), c.k)) AS k FROM vectors v, {centroids} c GROUP BY v.row),
{name}_parts AS (SELECT n.k, unnest(v.v)::HUGEINT AS x, generate_subscripts(v.v, 1) AS d FROM {name}_near n JOIN vectors v USING (row)),
{name}_sums AS (SELECT k, d, sum(x) AS s, count(*)::HUGEINT AS n FROM {name}_parts GROUP BY k, d),
{name}_made AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY d) AS c FROM {name}_sums GROUP BY k),
{name} AS (SELECT o.k, coalesce(m.c, o.c) AS c FROM {centroids} o LEFT JOIN {name}_made m USING (k))"""


def oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """DuckDB SQL of the query's rows; products of doubles are exact there while components are small."""
    steps = [_round("c0" if r == 0 else f"c{r}", f"c{r + 1}") for r in range(rounds)]
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
vectors AS (SELECT *, list_inner_product(v, v) AS vv FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM vectors ORDER BY h, v LIMIT {k})),
{",".join(steps)},
far AS (SELECT v.row, v.vec_id, c.k, (v.vv - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c))::BIGINT AS d FROM vectors v, c{rounds} c),
final AS (SELECT row, any_value(vec_id) AS vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM far GROUP BY row)
SELECT f.vec_id, f.k::INTEGER AS cluster, f.d AS distance, sum(f.d) OVER (PARTITION BY f.k)::BIGINT AS cluster_inertia, sum(f.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM final f JOIN c{rounds} c USING (k)
"""
