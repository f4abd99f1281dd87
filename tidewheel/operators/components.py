"""Connected components over an edge table (large-star / small-star, Kiveris et al. 2014).

Every round is two aggregations with partial (map-side) minima and one join each, so a vertex
with very many neighbours is never gathered in one task. Rounds are cut by ``checkpoint()``,
which writes to the folder in ``spark.checkpoint.dir`` that all executors share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Large-star/small-star halves tree depth each round; this is far beyond log2 of any vertex count.
MAX_ROUNDS = 60


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, ``spark.checkpoint.dir``.

    Where the session has none, a local session gets one; a cluster's executors could not share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges hold u > v. Connect every larger neighbour of u to the smallest of u's closed neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges hold u > v. Connect u and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same components by union-find in one task, for an edge table whose counted size allows it."""
    kind = edges.schema["a"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()

    def run(batches):
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        ids = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array([root(x) for x in ids], arrow)], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int = 0) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges``; component is the smallest id reachable. Ids are strings or integers.

    Self loops contribute their vertex. An empty table gives an empty result. Nulls are ignored. Tables of at
    most ``one_task_edges`` edges are done in one task, which saves the rounds' overhead; others in rounds.
    """
    kind = "string" if edges.schema[a].dataType.simpleString() == "string" else "long"
    whole = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).dropna()
    if one_task_edges and whole.limit(one_task_edges + 1).count() <= one_task_edges:
        return _in_one_task(whole)
    stars = checkpointed(
        whole.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    loops = whole.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    mark = _mark(stars)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        stars = checkpointed(_small_star(_large_star(stars)))
        if (now := _mark(stars)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return (
        stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(roots)
        .unionByName(loops)
        .groupBy("id")
        .agg(F.min("component").alias("component"))
    )
