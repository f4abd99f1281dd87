"""Joins and searches by bounds give what those without give, and skip most of the work on clustered vectors."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import clusters, metric, similarity

DDL = "item_id string, embedding array<float>"


def frame(spark, matrix):
    return spark.createDataFrame([(f"i{k:05d}", [float(x) for x in v]) for k, v in enumerate(matrix)], DDL)


def grouped(seed, groups=30, of=40, dims=16, noise=0.05):
    rng = np.random.default_rng(seed)
    return (np.repeat(rng.normal(size=(groups, dims)), of, axis=0) + noise * rng.normal(size=(groups * of, dims))).astype(np.float32)


def pairs(df):
    return sorted((r["src"], r["dst"], round(r["sim"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    return frame(spark, grouped(1)).cache()


def test_no_pair_is_lost_whatever_the_pivots(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(150, 6)).astype(np.float32)
    spread[40:60] = spread[3] * 2  # equal and equally directed vectors
    spread[60:90] = spread[4]
    for matrix, threshold in ((spread, 0.8), (spread, -0.2), (grouped(3, 6, 20, 8), 0.95)):
        df = frame(spark, matrix)
        want = pairs(similarity.similar_pairs(df, threshold))
        assert want
        for pivots, rows in ((None, None), (metric._units(matrix[:3].astype(float)), 7)):
            assert pairs(metric.pruned_pairs(df, threshold, pivots, rows)) == want
    assert pairs(metric.pruned_pairs(frame(spark, spread[:1]), 0.5)) == pairs(metric.pruned_pairs(frame(spark, spread).limit(0), 0.5)) == []


def test_most_pairs_of_clustered_vectors_are_skipped(spark, clustered):
    done, whole = metric.work(metric.dealt_by_cells(clustered, 0.9), 1200)
    assert whole == 1200 * 1199 // 2 and done < 0.1 * whole


def test_a_forest_connects_what_all_pairs_connect(spark, clustered):
    def parts(edges):
        return sorted(map(tuple, clusters.item_components(edges).collect()))

    whole = similarity.similar_pairs(clustered, 0.9)
    few = similarity.similar_pairs(clustered, 0.9, block_rows=600, spanning=True).cache()
    assert parts(few) == parts(whole) == parts(metric.pruned_pairs(clustered, 0.9, block_rows=9, spanning=True))
    assert few.count() < whole.count() / 3 and set(pairs(few)) <= set(pairs(whole))


def test_nearest_by_index(spark, clustered, tmp_path):
    """Equal to the whole scan for a sample of items and strangers; few row groups can hold what is asked."""
    index = metric.VectorIndex.build(clustered, f"file://{tmp_path}/index", pivots=40, group_rows=40)
    stored = grouped(1)
    queries = [*stored[::300], np.random.default_rng(5).normal(size=16), -stored[0], stored[7] * 3]
    told = []
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/index/vectors/*.parquet")]
    columns = {groups[0].schema.column(k).path.split(".")[0]: k for k in range(groups[0].num_columns)}
    ranges = []
    for m in groups:
        for g in range(m.num_row_groups):
            stats = [m.row_group(g).column(columns[c]).statistics for c in ("cell", "angle")]
            ranges.append([(s.min, s.max) for s in stats])
    assert len(ranges) > 20
    for q in queries:
        q = [float(x) for x in q]
        want = [(r["item_id"], round(r["distance"], 9)) for r in similarity.nearest(clustered, q, 15, -1.0).collect()]
        assert [(r["item_id"], round(r["distance"], 9)) for r in index.nearest(q, 15, -1.0).collect()] == want
        asked = index.ranges(q, index.radius(q, 15) + metric.SLACK)
        told.append(sum(any(c0 <= c <= c1 and low <= a1 and high >= a0 for c, low, high in asked) for (c0, c1), (a0, a1) in ranges) / len(ranges))
    assert sum(told[:4]) / 4 < 0.15
    plan = index.candidates(queries[0], 0.1)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
    assert [r["item_id"] for r in index.nearest([0.0] * 16, 3).collect()] == [r["item_id"] for r in similarity.nearest(clustered, [0.0] * 16, 3).collect()]
    assert len(index.nearest([1.0] * 16, 5000, -1.0).collect()) == 1200 and '"cell": 0' in index.describe()


def test_near_by_index(spark, clustered, tmp_path):
    index = metric.VectorIndex.build(clustered, f"file://{tmp_path}/index", pivots=25)
    asked = frame(spark, [*grouped(1)[::90], *np.random.default_rng(6).normal(size=(5, 16)), np.zeros(16)]).withColumn("item_id", F.concat(F.lit("q"), "item_id"))
    for threshold in (0.99, 0.5):
        want = sorted((r["item_id"], r["match"], round(r["sim"], 9)) for r in similarity.cross_pairs(similarity.eligible(asked), clustered, threshold).collect())
        assert want and sorted((r["item_id"], r["match"], round(r["sim"], 9)) for r in index.near(asked, threshold).collect()) == want
    assert index.near(asked.limit(0), 0.5).collect() == []


def test_near_by_index_multiplies_blocks(spark, tmp_path):
    """Rings of more than a block, blocks of many rings and several blocks of asked vectors; no cosine is made row by row."""
    rng = np.random.default_rng(12)
    matrix = np.concatenate([rng.normal(size=(300, 8)), np.ones((40, 8)) + 1e-3 * rng.normal(size=(40, 8))])
    stored = frame(spark, matrix).cache()
    index = metric.VectorIndex.build(stored, f"file://{tmp_path}/index", pivots=6)
    asked = frame(spark, matrix[::7] + 0.1).withColumn("item_id", F.concat(F.lit("q"), "item_id")).cache()
    want = sorted((r["item_id"], r["match"], r["sim"]) for r in similarity.cross_pairs(asked, stored, 0.6).collect())
    for rows in (None, 16):
        got = index.near(asked, 0.6, rows)
        assert sorted((r["item_id"], r["match"], r["sim"]) for r in got.collect()) == want and len(want) > 1000
        assert "zip_with" not in got._jdf.queryExecution().toString()


def test_sums_of_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{min(k % 17, 9)}", [float(x) for x in rng.normal(size=5)]) for k in range(500)] + [("zero", [0.0] * 5)] * 3
    df = spark.createDataFrame(rows, "key string, embedding array<double>").repartition(6)
    for scaled in (False, True):
        got = {r["key"]: (r["n"], r["total"], r["squares"]) for r in similarity.vector_sums(df, "key", scaled).collect()}
        for key in {k for k, _ in rows}:
            m = np.array([v for k, v in rows if k == key])
            m = metric._units(m) if scaled else m
            assert got[key][0] == len(m) and np.allclose(got[key][1], m.sum(axis=0)) and np.isclose(got[key][2], (m * m).sum())


def test_classes_of_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(similarity.F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [2.0]), ("d", [0.0]), ("e", [-0.0])], DDL)
    assert sorted((r["item_id"], r["rep"]) for r in similarity.vector_classes(df).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d")]


def plain_low(matrix):
    """Least cosine of all pairs; zero vectors have cosine 0 with everything."""
    m = matrix.astype(np.float64)
    length = np.linalg.norm(m, axis=1)
    sims = (m @ m.T) / np.where(np.outer(length, length) == 0, 1, np.outer(length, length))
    return min(1.0, sims[np.triu_indices(len(m), 1)].min())


def test_the_farthest_pair_is_found_whatever_the_cluster_looks_like(spark):
    rng = np.random.default_rng(5)
    ball = rng.normal(size=(90, 5)) * 0.2 + 1
    shapes = {
        "ball": ball,
        "spread": rng.normal(size=(80, 4)),
        "line": np.stack([np.ones(50), np.linspace(-1, 1, 50)], axis=1),
        "zero among them": np.vstack([ball[:30], np.zeros((1, 5))]),
        "no centre": np.vstack([ball[:20], -ball[:20]]),
        "one direction": np.outer(np.arange(1, 30), [0.3, 0.1, 0.7]),
        "all the same": np.repeat(ball[:1], 25, axis=0),
        "two": ball[:2],
    }
    wide = {k: np.pad(m, ((0, 0), (0, 5 - m.shape[1]))).astype(np.float32) for k, m in shapes.items()}
    named = [(key, f"{key}{k:04d}", [float(x) for x in v]) for key, matrix in wide.items() for k, v in enumerate(matrix)]
    df = spark.createDataFrame(named, "cluster_key string, item_id string, embedding array<float>")
    # each cluster's vectors apart: an equal vector of another cluster is no copy of this one
    moved = df.withColumn("rep", F.col("item_id"))
    for rows in (6, 40):
        got = {r["cluster_key"]: r["min_similarity"] for r in similarity.pair_statistics(df.select("cluster_key", "item_id"), moved.select("item_id", "embedding", "rep"), rows).collect()}
        assert got == pytest.approx({k: plain_low(m) for k, m in wide.items()}, abs=1e-9)


def test_bounds_leave_few_pairs_of_a_ball_shaped_cluster(spark):
    rng = np.random.default_rng(6)
    n = 20_000
    turn, wide = rng.uniform(0, 2 * np.pi, n), 0.5 * np.sqrt(rng.uniform(size=n))
    matrix = np.stack([np.cos(wide), np.sin(wide) * np.cos(turn), np.sin(wide) * np.sin(turn)], axis=1)
    rows = spark.createDataFrame([("c", f"i{k:05d}", v) for k, v in enumerate(matrix.tolist())], "cluster_key string, item_id string, embedding array<double>")
    centres = spark.createDataFrame([("c", 256, matrix.sum(axis=0).tolist())], "cluster_key string, most int, total array<double>")
    far, known = similarity._far_rows(rows, centres)
    _, bands = similarity._dealt_far(far)
    work = similarity.far_work(bands).first()
    assert work["pairs"] < 0.02 * n * (n - 1) / 2 and work["rows"] < 0.3 * n
    got = similarity.pair_statistics(rows.select("cluster_key", "item_id"), rows.select("item_id", "embedding"), 256).first()["min_similarity"]
    assert got <= known.first()["low"] and got == pytest.approx(min((matrix[k : k + 1000] @ matrix.T).min() for k in range(0, n, 1000)), abs=1e-12)
