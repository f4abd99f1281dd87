"""Vectors in cells around pivots: an all-pairs join that skips cells too far apart, and an index for nearest and near vectors.

Angles between vectors are a metric, so what lies in a cell is bounded by the angle to its pivot: two vectors within an
angle t are both within t of the other's cell. Pivots come from a sample of bounded size; cells, radii and every bound
are over all vectors, and what bounds let through is compared exactly, so nothing is lost whatever the pivots are.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.vectors import cosine, l2, l2_to_cosine, unit
from tidewheel.operators import similarity
from tidewheel.operators.components import checkpointed

#: Pivots, and vectors of the sample that they are chosen from.
PIVOTS, SAMPLE = 64, 2048
#: Slack of angles: they are found by another route than the cosines that decide.
SLACK = 1e-6
#: Width of the rings of a cell that an index is joined by, vectors of an index's row group, and reference pivots of a row.
RING, GROUP_ROWS, REFERENCES = 0.05, 2048, 4
#: Vectors from which cells are worth their cost.
PRUNE_FROM = 20_000


def _units(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(length == 0, 1, length)[:, None]


def angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles of the rows of a matrix to unit pivots."""
    return np.arccos(np.clip(_units(matrix) @ pivots.T, -1.0, 1.0))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """At most ``count`` unit vectors, each as far from the ones before it as a sample of ``sample`` vectors has."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    points = _units(np.array([r["embedding"] for r in rows], np.float64))
    chosen, near = [0], angles(points, points[:1])[:, 0]
    while len(chosen) < count and near.max() > SLACK:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, angles(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def in_cells(vectors: DataFrame, pivots: np.ndarray, references: int = 0) -> DataFrame:
    """``(item_id, embedding, cell, angle, r0, r1, ...)``: the nearest pivot, the angle to it, and to the first few pivots."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    names = [f"r{k}" for k in range(min(references, len(pivots)))]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                away = angles(_matrix(batch.column(1)), pivots)
                cell = np.argmin(away, axis=1)
                columns = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), *(pa.array(away[:, k].copy()) for k in range(len(names)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["item_id", "embedding", "cell", "angle", *names])

    ddl = f"item_id string, embedding {kind}, cell int, angle double" + "".join(f", {n} double" for n in names)
    return vectors.select("item_id", "embedding").mapInArrow(run, ddl)


@dataclass(frozen=True)
class Cells:
    """How many vectors each cell has, and the least and greatest angle of one to its pivot."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def may_hold(self, away: np.ndarray, within: float) -> np.ndarray:
        """Whether a cell may hold something within an angle of a point that is ``away`` from its pivot."""
        return (self.n > 0) & (away - self.high <= within + SLACK) & (self.low - away <= within + SLACK)


def cells_of(placed: DataFrame, pivots: int) -> Cells:
    n, low, high = np.zeros(pivots, np.int64), np.full(pivots, np.inf), np.full(pivots, -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row a pivot
        n[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return Cells(n, low, high)


def dealt_by_cells(vectors: DataFrame, threshold: float, pivots: np.ndarray | None = None, block_rows: int | None = None) -> DataFrame:
    """Vectors dealt to pairs of blocks as ``similar_pairs`` deals them, blocks being parts of cells: each vector goes only to
    the blocks of cells that may hold something within the threshold's angle of it.
    """
    pivots = choose_pivots(vectors) if pivots is None else pivots
    placed = checkpointed(in_cells(vectors, pivots))
    cells, within = cells_of(placed, len(pivots)), math.acos(max(-1.0, min(1.0, threshold)))
    rows = block_rows or max(1, similarity.BLOCK_BYTES // (4 * max(1, pivots.shape[1])))
    blocks = -(-cells.n // rows)
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                may = cells.may_hold(angles(_matrix(batch.column(1)), pivots), within)
                may[np.arange(len(may)), batch.column(2).to_numpy()] = True
                others = [np.concatenate([np.arange(first[c], first[c + 1]) for c in np.flatnonzero(m)]) for m in may]
                offsets = np.cumsum([0, *map(len, others)])
                arrow = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(others).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), arrow], ["item_id", "embedding", "cell", "others"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    sent = placed.select("item_id", "embedding", "cell").mapInArrow(run, f"item_id string, embedding {kind}, cell int, others array<int>")
    at = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
    number = (at(first[:-1]) + F.pmod(F.xxhash64("item_id"), at(np.maximum(blocks, 1)))).cast("int")
    return similarity._dealt(sent, [], number, F.col("others"))


def pruned_pairs(vectors: DataFrame, threshold: float, pivots: np.ndarray | None = None, block_rows: int | None = None, spanning: bool = False) -> DataFrame:
    """The pairs of ``similarity.similar_pairs``, of which vectors in cells too far apart are never multiplied."""
    different = similarity._classed(vectors).filter("item_id = rep").select("item_id", "embedding")
    if different.isEmpty():
        return similarity.similar_pairs(vectors, threshold)
    return similarity.pairs_of_blocks(dealt_by_cells(different, threshold, pivots, block_rows), threshold, spanning).select("src", "dst", "sim")


def work(dealt: DataFrame, vectors: int) -> tuple[int, int]:
    """How many pairs of vectors a dealing multiplies, and how many there are; the rest is skipped."""
    sides = dealt.groupBy("p", "q").agg(F.count_if(F.col("b") == F.col("p")).alias("l"), F.count_if(F.col("b") == F.col("q")).alias("r"))
    pairs = F.when(F.col("p") == F.col("q"), F.col("l") * (F.col("l") - 1) / 2).otherwise(F.col("l") * F.col("r"))
    return int(sides.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]), vectors * (vectors - 1) // 2


def any_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs by whichever dealing costs less; both give the same pairs."""
    return (pruned_pairs if classes.count() >= PRUNE_FROM else similarity.similar_pairs)(classes, threshold)


# ------------------------------------------------------------------ index


class VectorIndex:
    """Vectors on disk in the order of (cell, angle), with their angles to a few reference pivots, under ``path``.

    Row groups are small, so ranges of cell, angle and references, pushed to the scan, skip most of them. Pivots and
    cells are a row each. Zero vectors are not indexed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # a row a pivot
        self.pivots = np.array([r["pivot"] for r in head], np.float64)
        self.cells = Cells(np.array([r["n"] for r in head]), np.array([r["low"] for r in head], float), np.array([r["high"] for r in head], float))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS) -> VectorIndex:
        spark, kept = vectors.sparkSession, similarity.eligible(vectors).select("item_id", "embedding")
        chosen = choose_pivots(kept, pivots)
        placed = in_cells(kept, chosen, REFERENCES).withColumn("ring", F.floor(F.col("angle") / RING).cast("int"))
        ordered = placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
        size = group_rows * max(1, chosen.shape[1]) * 4
        ordered.write.option("parquet.block.size", size).option("parquet.block.size.row.check.min", min(100, group_rows)).option("parquet.page.size.row.check.min", min(100, group_rows)).parquet(f"{path}/vectors")
        cells = cells_of(spark.read.parquet(f"{path}/vectors").select("cell", "angle"), len(chosen))
        head = [(k, [float(x) for x in p], int(cells.n[k]), float(cells.low[k]), float(cells.high[k])) for k, p in enumerate(chosen)]
        spark.createDataFrame(head, "cell int, pivot array<double>, n bigint, low double, high double").coalesce(1).write.parquet(f"{path}/pivots")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def ranges(self, query: list[float], within: float) -> list[tuple[int, float, float]]:
        """``(cell, low, high)``: the angles to each cell's pivot that vectors within an angle of the query can have."""
        away = angles(np.array([query], np.float64), self.pivots)[0]
        return [(int(c), float(away[c] - within - SLACK), float(away[c] + within + SLACK)) for c in np.flatnonzero(self.cells.may_hold(away, within))]

    def candidates(self, query: list[float], within: float) -> DataFrame:
        """Rows that bounds let through, by filters that reach the scan."""
        if not (ranges := self.ranges(query, within)):
            return self.rows().limit(0)
        c, a = F.col("cell"), F.col("angle")
        of_cell = functools.reduce(operator.or_, [(c == k) & (a >= low) & (a <= high) for k, low, high in ranges])
        away = angles(np.array([query], np.float64), self.pivots[:REFERENCES])[0]
        near = [(F.col(f"r{k}") >= float(x - within - SLACK)) & (F.col(f"r{k}") <= float(x + within + SLACK)) for k, x in enumerate(away)]
        return self.rows().filter(functools.reduce(operator.and_, [of_cell, *near]))

    def radius(self, query: list[float], k: int) -> float:
        """An angle within which ``k`` vectors are known to be: that of the k-th in the cells nearest to the query."""
        away = angles(np.array([query], np.float64), self.pivots)[0]
        order, some, n = np.argsort(away), [], 0
        for c in order:
            if n >= k:
                break
            some.append(int(c))
            n += int(self.cells.n[c])
        if n < k:
            return math.pi
        q = F.array(*[F.lit(float(x)) for x in query])
        best = self.rows().filter(F.col("cell").isin(some)).select(cosine(F.col("embedding"), q).alias("s")).orderBy(F.desc("s")).limit(k).collect()  # k rows
        return math.acos(max(-1.0, min(1.0, best[-1]["s"])))

    def nearest(self, query: list[float], k: int = 20, threshold: float = 0.0) -> DataFrame:
        """What ``similarity.nearest`` gives of non-zero vectors; only rows within the k-th known distance are read. A zero query reads all."""
        within = self.radius(query, k) if any(query) else math.pi
        rows = self.candidates(query, within + SLACK) if within < math.pi else self.rows()
        q = unit(F.array(*[F.lit(float(x)) for x in query]))
        top = rows.select("item_id", l2(unit(F.col("embedding")), q).alias("distance")).orderBy("distance", "item_id").limit(k)
        return top.filter(l2_to_cosine(F.col("distance")) >= threshold)

    def near(self, asked: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
        """``(item_id, match, sim)`` as ``similarity.cross_pairs`` gives: asked vectors are multiplied with blocks of neighbouring rings
        that may hold their matches.

        The scan is limited to the rings that any asked vector reaches, at most one range a cell.
        """
        pivots, cells, within = self.pivots, self.cells, math.acos(max(-1.0, min(1.0, threshold)))
        kept = similarity.eligible(asked).select("item_id", "embedding")
        rows = block_rows or max(1, similarity.BLOCK_BYTES // (4 * max(1, pivots.shape[1] if pivots.ndim == 2 else 1)))
        parts = max(1, -(-kept.count() // rows))
        blocks = self._blocks(rows)
        if not len(blocks):
            return self.spark.createDataFrame([], "item_id string, match string, sim double")
        of_cell, least, most = blocks[:, 0], blocks[:, 1], blocks[:, 2]

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                away = angles(_matrix(batch.column(1)), pivots)
                low, high = (np.floor(np.clip(x, cells.low, cells.high) / RING).astype(np.int64) for x in (away - within - SLACK, away + within + SLACK))
                to = cells.may_hold(away, within)[:, of_cell] & (low[:, of_cell] <= most) & (high[:, of_cell] >= least)
                others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(to.sum(axis=1))), pa.int32()), pa.array((np.nonzero(to)[1] + parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), others], ["item_id", "embedding", "others"])

        kind = asked.schema["embedding"].dataType.simpleString()
        number = F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")
        reached = checkpointed(kept.mapInArrow(run, f"item_id string, embedding {kind}, others array<int>"))
        wanted = np.array(sorted(r[0] for r in reached.select(F.explode("others")).distinct().collect()), np.int64) - parts  # a row a block
        if not len(wanted):
            return self.spark.createDataFrame([], "item_id string, match string, sim double")
        c, r = F.col("cell"), F.col("ring")
        spans = [(k, least[mine].min(), most[mine].max()) for k in np.unique(of_cell[wanted]) for mine in [wanted[of_cell[wanted] == k]]]
        held = self.rows().filter(functools.reduce(operator.or_, [(c == int(k)) & (r >= int(low)) & (r <= int(high)) for k, low, high in spans]))
        table = self.spark.createDataFrame([(int(k), int(x), int(n), parts + int(b)) for b, (k, lo, hi, n) in enumerate(blocks) if n for x in range(lo, hi + 1)], "cell int, ring int, n int, block int")
        placed = held.join(F.broadcast(table), ["cell", "ring"]).withColumn("block", F.col("block") + F.pmod(F.xxhash64("item_id"), F.col("n")).cast("int"))
        both = F.col("embedding") if held.schema["embedding"].dataType == asked.schema["embedding"].dataType else F.col("embedding").cast("array<double>")
        ask = reached.select("item_id", both.alias("embedding"), number.alias("b"), "others")
        hold = placed.select("item_id", both.alias("embedding"), F.col("block").alias("b"), F.sequence(F.lit(0), F.lit(parts - 1)).alias("others"))
        return similarity.matches_of_blocks(similarity._dealt(ask.unionByName(hold), [], F.col("b"), F.col("others")), threshold)

    def _blocks(self, rows: int) -> np.ndarray:
        """``(cell, first ring, last ring, n)`` of blocks of at most about ``rows`` vectors: neighbouring rings, or one of ``n`` shares of a
        ring of more; the first share has ``n``, the others 0.
        """
        out: list[list[int]] = []
        size = 0
        for r in self.rows().groupBy("cell", "ring").agg(F.count("*").alias("n")).orderBy("cell", "ring").collect():  # a row a ring
            shares = -(-r["n"] // rows)
            if shares == 1 and out and out[-1][0] == r["cell"] and out[-1][3] == 1 and size + r["n"] <= rows:
                out[-1][2], size = r["ring"], size + r["n"]
                continue
            out += [[r["cell"], r["ring"], r["ring"], shares if k == 0 else 0] for k in range(shares)]
            size = r["n"]
        return np.array(out, np.int64).reshape(-1, 4)

    def describe(self) -> str:
        """Cells and their sizes as JSON."""
        return json.dumps([{"cell": k, "n": int(n), "radius": round(float(h), 4)} for k, (n, h) in enumerate(zip(self.cells.n, self.cells.high, strict=True))])
