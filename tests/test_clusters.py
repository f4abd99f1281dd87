"""Geometric cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import clusters, similarity
from tidewheel.operators.components import connected_components

ITEM = "item_id string, type string, number long, repo string, title string, body string, state string, author string, author_is_bot boolean, created_at timestamp, ci_status string, review_count int, additions int, deletions int, has_tests boolean, closes_issues array<long>"


def items(spark, numbers, bots=()):
    rows = [(f"o/r:pr:{n}", "pr", n, "o/r", f"t{n}", "", "open", "dependabot" if n in bots else "ann", None, None, None, 0, None, None, None, None) for n in numbers]
    return spark.createDataFrame(rows, ITEM)


def vectors(spark, table):
    return spark.createDataFrame([(f"o/r:pr:{n}", [float(x) for x in v]) for n, v in table.items()], "item_id string, embedding array<float>")


def angle(*degrees):
    return {k + 1: [math.cos(math.radians(d)), math.sin(math.radians(d))] for k, d in enumerate(degrees)}


def found(spark, table, threshold=0.85, numbers=None, bots=()):
    c, m = clusters.find_clusters(items(spark, numbers or table, bots), vectors(spark, table), threshold)
    shape = {}
    for r in m.collect():
        shape.setdefault(r["cluster_id"], set()).add(r["number"])
    return shape, {r["cluster_id"]: r for r in c.collect()}


@pytest.mark.parametrize(
    ("table", "want"),
    [
        ({1: [1, 0, 0, 0], 2: [0, 1, 0, 0]}, []),
        ({1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4]}, [{1, 2, 3}]),
        ({1: [1, 1, 1, 1], 2: [1, 1, 1, 1], 3: [0, 0, 0, 0]}, [{1, 2}]),
        (angle(0, 25, 50), [{1, 2, 3}]),
        (angle(0, 25, 50, -25), [{1, 2, 3, 4}]),
        (angle(*range(16)), [set(range(1, 17))]),
        ({10: [1, 0], 11: [1, 0], 2: [0, 1], 3: [0, 1]}, [{2, 3}, {10, 11}]),
    ],
)
def test_shapes(spark, table, want):
    shape, stats = found(spark, table)
    assert [shape[k] for k in sorted(shape)] == want
    if want == [{1, 2, 3}] and len(table[1]) == 4:
        assert stats[1]["avg_similarity"] == pytest.approx(1) and stats[1]["min_similarity"] == pytest.approx(1)
    if want == [{1, 2, 3}] and len(table[1]) == 2:
        assert stats[1]["min_similarity"] == pytest.approx(math.cos(math.radians(50)), abs=1e-6)


def test_bots_leave_before_edges_and_strangers_stay(spark):
    table = {1: [1, 0], 2: [1, 0.3], 3: [1, 0.6]}
    assert found(spark, table, 0.9, bots={2})[0] == {}
    assert found(spark, table, 0.9, numbers=[1, 3])[0] == {1: {1, 3}}


def test_blocks_equal_definition(spark):
    table = {n: [math.sin(n * k + k * k) for k in range(1, 9)] for n in range(60)}
    v = vectors(spark, table)
    want = {(r["src"], r["dst"]): r["sim"] for r in similarity.similar_pairs_reference(v, 0.3).collect()}
    for rows in (None, 512, 7):
        assert {(r["src"], r["dst"]): r["sim"] for r in similarity.similar_pairs(v, 0.3, rows).collect()} == want


def test_equal_vectors_are_one_vertex(spark):
    """Many equal vectors: pairs among the different ones only, stars for the rest, the same clusters and statistics."""
    table = {n: [1.0, 2.0, 3.0] if n % 3 else [float(n), 1.0, -1.0] for n in range(1, 300)}
    v = vectors(spark, table)
    classes = {r["item_id"]: r["rep"] for r in similarity.vector_classes(v).collect()}
    assert all(classes[f"o/r:pr:{n}"] == ("o/r:pr:1" if n % 3 else f"o/r:pr:{n}") for n in table)
    every = similarity.similar_pairs_reference(v, 0.9)
    firsts = set(classes.values())
    want = {(r["src"], r["dst"]): r["sim"] for r in every.collect() if {r["src"], r["dst"]} <= firsts}
    assert {(r["src"], r["dst"]): r["sim"] for r in similarity.similar_pairs(v, 0.9).collect()} == want
    edges = similarity.similar_edges(v, 0.9)
    assert edges.count() == len(want) + sum(a != b for a, b in classes.items())
    parts = {r["item_id"]: r["cluster_key"] for r in clusters.item_components(edges).collect()}
    whole = connected_components(every, "src", "dst")
    assert parts == {r["id"]: r["component"] for r in whole.collect()}
    members = spark.createDataFrame([(7, i) for i in classes], "cluster_key long, item_id string")
    pairs = similarity.similar_pairs_reference(v, -1.0).agg(F.avg("sim"), F.min("sim")).first()
    got = similarity.pair_statistics(members, v).first()
    assert got["min_similarity"] == pairs[1] and got["avg_similarity"] == pytest.approx(pairs[0], abs=1e-12)


def test_statistics_do_not_depend_on_tiles(spark):
    table = {n: [math.cos(n / 40), math.sin(n / 40), 0.1 * n % 1] for n in range(40)}
    members = spark.createDataFrame([(7, f"o/r:pr:{n}") for n in table], "cluster_key long, item_id string")
    one = similarity.pair_statistics(members, vectors(spark, table)).first()
    many = similarity.pair_statistics(members, vectors(spark, table), 6).first()
    assert one["min_similarity"] == many["min_similarity"] and one["avg_similarity"] == pytest.approx(many["avg_similarity"], abs=1e-12)


def test_components_in_rounds_and_in_one_task(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (500, 500)] + [(1000, n) for n in range(1001, 1100)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {n: 0 for n in range(41)} | {100: 100, 200: 100, 300: 100, 500: 500} | {n: 1000 for n in range(1000, 1100)}
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == want
    assert {r["id"]: r["component"] for r in connected_components(df, one_task_edges=10_000).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_knn_normalises_and_cuts_after_the_limit(spark):
    v = vectors(spark, {1: [3, 0], 2: [7, 0], 3: [0, 1]})
    assert sorted(r["item_id"] for r in similarity.nearest(v, [5, 0], 20, 0.99).collect()) == ["o/r:pr:1", "o/r:pr:2"]
    assert similarity.nearest(v, [5, 0], 1, 0.0).count() == 1


def test_sections_classify_by_best_positive_match(spark):
    v = vectors(spark, {1: [1, 1, 1], 2: [-1, 0, 0], 3: [0, 0, 0]})
    s = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0]), (1, "b", [1.0, 0.0, 0.0])], "idx int, heading string, embedding array<double>")
    got = {r["item_id"]: (round(r["score"], 3), r["classification"], r["section"]) for r in similarity.best_section(v, s).collect()}
    assert got == {"o/r:pr:1": (0.577, "drifting", "a"), "o/r:pr:2": (0.0, "off-vision", "")}


def test_lengths_must_agree(spark):
    from tidewheel.functions.vectors import cosine

    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="length"):
        df.select(cosine(F.col("a"), F.col("b"))).collect()
