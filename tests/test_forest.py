"""Edges that join what all pairs join: the same components, few edges, and clusters that never list their pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import clusters, forest, similarity

DDL = "item_id string, embedding array<float>"


@pytest.fixture(scope="module")
def mixed(spark):
    """One dense component, three groups, a chain that only far blocks close, and copies."""
    rng = np.random.default_rng(4)
    turn = np.linspace(0, 2, 60)
    chain = np.column_stack([np.cos(turn), np.sin(turn), np.zeros((60, 6))])
    matrix = np.concatenate([rng.normal(size=(500, 8)), 9 * np.repeat(np.eye(8)[5:], 40, axis=0) + 0.3 * rng.normal(size=(120, 8)), chain, chain[:20]])
    return spark.createDataFrame([(f"i{k:04d}", [float(x) for x in v]) for k, v in enumerate(matrix.astype(np.float32))], DDL).cache()


def parts(edges):
    return sorted(map(tuple, clusters.item_components(edges).collect()))


@pytest.mark.parametrize("threshold", [0.7, 0.93, 0.999])
def test_forests_connect_what_pairs_connect(spark, mixed, threshold):
    whole = similarity.similar_edges(mixed, threshold).cache()
    known = {(r["src"], r["dst"]) for r in whole.collect()}
    for prune_from in (0, 10**9):
        few = forest.joining_edges(mixed, threshold, block_rows=100, prune_from=prune_from).cache()
        assert parts(few) == parts(whole) and {(r["src"], r["dst"]) for r in few.collect()} <= known
        assert threshold > 0.7 or few.count() < whole.count() / 3


def test_refinement_without_edges(spark, mixed):
    for threshold in (0.7, 0.9):
        classes = similarity.vector_classes(mixed).cache()
        edges = similarity.similar_edges(classes, threshold).cache()
        members = clusters.item_components(edges).cache()
        want = sorted(map(tuple, clusters.refine(members, edges, classes, threshold).select("item_id", "cluster_key").collect()))
        assert sorted(map(tuple, clusters.refine(members, None, classes, threshold).select("item_id", "cluster_key").collect())) == want
    near = similarity.touching(mixed.filter("item_id < 'i0100'"), mixed.filter("item_id >= 'i0500'"), 0.9)
    pairs = similarity.cross_pairs(mixed.filter("item_id < 'i0100'"), mixed.filter("item_id >= 'i0500'"), 0.9)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, pairs.select("item_id").distinct().collect()))


def test_cells_are_left_where_they_keep_nothing_apart(spark):
    """Vectors spread evenly go to as many blocks as their number needs, not to every cell; those in groups go to few cells."""
    rng = np.random.default_rng(6)
    spread, tight = rng.normal(size=(600, 24)), 9 * np.repeat(np.eye(24), 25, axis=0) + 0.1 * rng.normal(size=(600, 24))
    for matrix, cells in ((spread, False), (tight, True)):
        rows = [(f"i{k:04d}", [float(x) for x in v], f"i{k:04d}", 0) for k, v in enumerate(matrix.astype(np.float32))]
        placed = spark.createDataFrame(rows, DDL + ", label string, group int").cache()
        sent = forest._dealt(placed, 0.4, [600], 300, 0).count()
        assert (sent < 600 * 4) if cells else (sent == 600 * 2)


def test_components_of_blocks_are_those_of_all_pairs(spark, mixed):
    """Components come without listing edges; what a block joins is not searched again."""
    classes = similarity.vector_classes(mixed).cache()
    for threshold in (0.7, 0.93):
        want = parts(similarity.similar_edges(classes, threshold))
        for prune_from in (0, 10**9):
            assert sorted(map(tuple, forest.joined(classes, threshold, block_rows=100, prune_from=prune_from).collect())) == want


def test_large_components_meet_by_a_few_vectors(spark, monkeypatch):
    """On a dense graph every block has a large component; their vectors are not sent to one another once a few have met."""
    rng = np.random.default_rng(8)
    rows = [(f"i{k:04d}", [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1200, 6)).astype(np.float32))]
    vectors, sent = spark.createDataFrame(rows, DDL).cache(), []
    dealt = forest._dealt
    monkeypatch.setattr(forest, "_dealt", lambda *a: sent.append(dealt(*a)) or sent[-1])
    assert parts(forest.joining_edges(vectors, 0.7, block_rows=150)) == parts(similarity.similar_edges(vectors, 0.7))
    assert sent[0].count() < 2 * 1200  # to each of the other blocks: over 8,000


def test_single_precision_proposes_and_double_decides():
    """A threshold that is some pair's very cosine: the pairs are those of the sums from left to right."""
    matrix = np.random.default_rng(9).normal(size=(200, 48)) * 1e3
    i, j = np.triu_indices(200, 1)
    exact = similarity._fold(matrix[i], matrix[j])
    for threshold in np.sort(exact)[[-5, -400]]:
        want = {(a, b) for a, b, s in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True) if s >= threshold}
        least = threshold - similarity._margin(48)
        got = {(a, b) for x, y, sim in similarity._pairs_in(matrix, matrix, True, lambda s, least=least: s >= least) for a, b, s in zip(x.tolist(), y.tolist(), sim.tolist(), strict=True) if s >= threshold}
        assert got == want


def test_large_clusters_known_to_be_loose_need_no_more_products(spark):
    """Confidence is the same with and without exact minima."""
    turn = np.linspace(0, 2.5, 90)
    matrix = np.concatenate([np.column_stack([np.cos(turn), np.sin(turn), 0 * turn]), np.column_stack([0 * turn, 0.01 * turn, 1 + 0 * turn])])
    rows = spark.createDataFrame([(f"i{k:03d}", [float(x) for x in v], k // 90) for k, v in enumerate(matrix)], "item_id string, embedding array<double>, cluster_key int").cache()
    full, short = (similarity.pair_statistics(rows.select("cluster_key", "item_id"), rows.select("item_id", "embedding"), 20, enough).collect() for enough in (None, 0.8))
    level = lambda found: sorted((r["cluster_key"], r["min_similarity"] >= 0.9, r["min_similarity"] >= 0.8) for r in found)
    assert level(full) == level(short) == [(0, False, False), (1, True, True)]
