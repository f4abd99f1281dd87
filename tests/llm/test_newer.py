"""Centroid clustering, collocations and order-sensitive fingerprints against their definitions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import collocations as co
from tidewheel.llm import kdtree_clusters as kd
from tidewheel.llm import order_minhash as om
from tidewheel.llm import queries

# ------------------------------------------------------------------ 11 centroid clustering


def plain_clusters(rows, k, rounds, dims, scale, seed=1):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((mark(i), v) for i, v in kept)[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    own = [nearest(v) for _, v in kept]
    far = [away(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    inertia = Counter()
    for o, d in zip(own, far, strict=True):
        inertia[o] += d
    return sorted(((i, o, d, inertia[o], sum(far), tuple(centroids[o])) for (i, _), o, d in zip(kept, own, far, strict=True)), key=str)


def got_clusters(df, **options):
    return sorted(((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in kd.clusters(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, seed):
    """Small whole numbers, so that distances and marks tie; repeated, null and odd vectors; extra columns."""
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-2, 2)) / 4 for _ in range(3)]) for i in range(90)]
    rows += [rows[3], rows[3], (3, [0.25, 0.0, 0.5]), (None, [0.1, 0.2, -0.3]), (None, [0.1, 0.2, 0.9])]
    rows += [(200, None), (201, []), (202, [0.1, 0.2]), (203, [0.1, 0.2, float("nan")]), (204, [float("inf"), 0.0, 0.0]), (205, [None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    options = {"k": 5, "rounds": 3, "dims": 3, "scale": 4}
    assert got_clusters(df, tree_rows=17, leaf_rows=2, **options) == plain_clusters(rows, **options)


def test_clusters_without_vectors_and_with_few(spark):
    ddl = "vec_id long, embedding array<float>"
    assert got_clusters(spark.createDataFrame([], ddl), dims=2) == []
    few = [(1, [0.5, 1.0]), (2, [0.5, -1.0])]
    assert got_clusters(spark.createDataFrame(few, ddl), k=16, dims=2) == plain_clusters(few, 16, 3, 2, 64)
    with pytest.raises(Exception, match="passes"):
        got_clusters(spark.createDataFrame([(1, [1e30, 0.0])], ddl), dims=2)


def test_filtering_prunes_and_assigns_whole_nodes():
    """In well separated groups few vectors are looked at one by one, and sums are those of the vectors."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-4000, 4000, (8, 6))
    points = np.repeat(middles, 500, axis=0) + rng.integers(-20, 20, (4000, 6))
    tree, order = kd.build(points)
    assert (points[order] == tree.points).all()
    n, sums, squares, singly = kd._totals(tree, middles)
    own = np.argmin(kd.distances(points, middles), axis=1)
    assert singly < 400 and n.tolist() == np.bincount(own, minlength=8).tolist()
    assert all((sums[c] == points[own == c].sum(axis=0)).all() and squares[c] == int((points[own == c] ** 2).sum()) for c in range(8))


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    points = rng.integers(-(1 << 26), 1 << 26, (300, 64))
    centroids = points[:7].copy()
    n, sums, squares, _ = kd._totals(kd.build(points)[0], centroids)
    whole = [[int(x) for x in p] for p in points]
    own = [min(range(7), key=lambda c: (sum((x - y) ** 2 for x, y in zip(p, whole[c], strict=True)), c)) for p in whole]
    assert n.tolist() == [own.count(c) for c in range(7)]
    for c in range(7):
        mine = [p for p, o in zip(whole, own, strict=True) if o == c]
        assert squares[c] == sum(x * x for p in mine for x in p) and sums[c].tolist() == [sum(x) for x in zip(*mine, strict=True)]


def test_cluster_query_columns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(64)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    got = queries.QUERIES["op11_centroid_clustering"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in plain_clusters(rows, 16, 3, 64, 64)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ 12 collocations


def plain_collocations(rows, longest, least, top, inside=50):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, rank, g.decode(), -a, left, right, total[lang], -s) for rank, (s, a, g, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "São", "paulo", "é", "\U0001f600", "a", "b", "c", "\x00", "z'z"]
    weights = [30, 20, 9, 9, 6, 6, 3, 3, 2, 2, 2, 1, 1]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.choice([0, 1, 2, 5, 40]))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", " !"]) for w in words)
        rows.append((text, rng.choice(["en", "pt", None, "und"])))
    return [*rows, rows[0], rows[0], (None, "en"), ("", None), ("x x x x x. x x x", "en"), ("p q " * 30, "qq")]


@pytest.mark.parametrize(("longest", "least", "top", "shipped", "bucket_words"), [(3, 2, 2000, 10**6, 10**6), (3, 3, 7, 0, 10**6), (2, 1, 5, 10**6, 40), (4, 2, 2000, 0, 50)])
def test_collocations_equal_plain_counts(spark, longest, least, top, shipped, bucket_words):
    """The vocabulary sent and joined, hot pivots spread, longer phrases, overlaps within a phrase."""
    rows = phrase_rows(longest)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = co.collocations(df, longest, least, top, shipped=shipped, bucket_words=bucket_words)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, longest, least, top)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None), ("", "en"), ("one", "en")]):
        assert co.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.randrange(10**14), a + rng.randrange(3)) for a in [rng.randrange(1, 10**15) for _ in range(200)]]
    got = co.with_score(spark.createDataFrame(rows, "a long, l long, r long")).collect()
    assert all(r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_packer_counts_across_flushes(monkeypatch):
    """Fragments packed often or once carry the same n-grams."""
    ids = np.array(random.Random(3).choices(range(6), k=4000))
    joined = np.array(random.Random(4).choices([True, True, True, False], k=4000))
    joined[-1] = False
    want = Counter()
    for i in range(4000):
        for n in (2, 3):
            g = tuple(ids[i : i + n])
            if len(g) == n and min(g) > 0 and joined[i : i + n - 1].all():
                want[tuple(map(int, g))] += 1
    for held in (64, 1 << 20):
        monkeypatch.setattr(co, "HELD", held)
        packer, found = co._Packer(3, 2, 3), Counter()
        batches = [b for at in range(0, 4000, 500) for b in packer.add(co.fragments(ids, joined, 3)[:, at : at + 500])]
        rest = co.fragments(ids, joined, 3)[:, 4000:]
        batches += [*packer.add(rest), *packer.rest()]
        assert co.fragments(ids, joined, 3).shape[1] <= 4000
        for b in batches:
            for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                columns, counts = list(np.frombuffer(data, np.uint32, n * 5).reshape(5, n)), np.frombuffer(data, np.int64, n, 20 * n)
                for out in co._mine(columns, counts, 1, 0, 3):
                    for g, a in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                        found[tuple(g)] += a
        assert found == want


def test_vocabulary_tells_equal_hashes_apart(monkeypatch):
    import pyarrow as pa

    words = pa.array([b"a", b"b", b"cc"], pa.large_binary())
    monkeypatch.setattr(co.Vocabulary, "_hashes", staticmethod(lambda w: np.zeros(len(w), np.uint64)))
    assert co.Vocabulary(words, np.array([3, 1, 2])).find(pa.array([b"cc", b"x", b"a", b"b"], pa.large_binary())).tolist() == [2, 0, 3, 1]


# ------------------------------------------------------------------ 13 order MinHash


def plain_compare(rows, scheme):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        a, b, c = (scheme.parts(x.encode()) for x in (text, other, following))
        out.append((k, len(text), hashlib.sha256(other.encode()).hexdigest(), scheme.fingerprint(text.encode()), scheme.fingerprint(other.encode()), om.likeness(a, b), om.likeness(a, c)))
    return sorted(out, key=str)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("buckets", [1, 5, 200])
def test_neighbours_over_ranges(spark, buckets):
    rng = random.Random(buckets)
    rows = [(i * 3 - 40, sentence(rng, rng.choice([0, 1, 3, 30]))) for i in range(90)] + [(900, None), (901, ""), (902, "\U0001f600é" * 50), (-(2**63), "least"), (2**63 - 1, "most"), (903, "x " * 40_000)]
    scheme = om.OrderMinHash()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("b", F.lit(1)).repartition(4)
    got = om.compare_with_next(df, scheme=scheme, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=str) == plain_compare(rows, scheme)


def test_neighbours_of_one_none_and_equal_ids(spark):
    ddl = "doc_id long, text string"
    assert om.compare_with_next(spark.createDataFrame([], ddl)).collect() == []
    one = om.compare_with_next(spark.createDataFrame([(7, "abcd")], ddl)).first()
    assert (one["n_chars"], one["edited_sha256"], one["near_next"]) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)
    rows = [(5, "same text here"), (5, "same text here"), (5, "other"), (None, "null id"), (None, "another null id"), (1, "least")]
    runs = [sorted(map(tuple, om.compare_with_next(spark.createDataFrame(rows, ddl).repartition(p), buckets=b).collect()), key=str) for p, b in ((1, 1), (3, 6))]
    assert runs[0] == runs[1] and len(runs[0]) == 6


def test_fingerprints_of_frames(spark):
    """Equal texts are equal, empty ones alike, other columns stay, and likeness by column is likeness."""
    rows = [(1, "some words stand here", "x"), (2, None, "y"), (3, "", None), (1, "some words stand here", "z"), (4, "ab", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, made string").withColumn("fingerprint", F.lit("old"))
    out = om.fingerprints(df)
    got = out.collect()
    assert out.columns == df.columns and sorted(r["made"] or "" for r in got) == ["", "q", "x", "y", "z"]
    by = {r["made"]: r["fingerprint"] for r in got}
    assert by["x"] == by["z"] != by["q"] and by["y"] == by[None] == "" and len(by["x"]) == 4 * 64
    pairs = out.alias("a").crossJoin(out.alias("b")).select(om.near(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("n"), F.col("a.fingerprint").alias("x"), F.col("b.fingerprint").alias("y"))
    parts = lambda f: np.frombuffer(bytes.fromhex(f), ">u2")
    assert all(r["n"] == om.likeness(parts(r["x"]), parts(r["y"])) for r in pairs.collect())
    assert om.fingerprints(df.limit(0)).collect() == []


def test_likeness_follows_edits_and_order():
    """More edits are less alike; a swapped order of parts, which plain MinHash cannot see, is less alike too."""
    rng = random.Random(9)
    scheme = om.OrderMinHash(orders=512)
    text = sentence(rng, 400).encode()
    seen = []
    for share in (0.0, 0.01, 0.05, 0.2):
        changed = bytearray(text)
        for i in rng.sample(range(len(text)), int(share * len(text) / 4)):
            changed[i] = ord("z")
        seen.append(om.likeness(scheme.parts(text), scheme.parts(bytes(changed))))
    assert seen[0] == 1.0 and seen == sorted(seen, reverse=True) and seen[1] > 0.8 > seen[2] > seen[3]
    half = len(text) // 2
    swapped = om.likeness(scheme.parts(text), scheme.parts(text[half:] + b" " + text[:half]))
    alone = om.OrderMinHash(orders=512, length=1)
    assert om.likeness(alone.parts(text), alone.parts(text[half:] + b" " + text[:half])) > 0.9 > swapped > 0.3


def test_long_texts_are_sorted_beside_their_places(monkeypatch):
    text = sentence(random.Random(1), 500).encode() * 3
    want = om.OrderMinHash().fingerprint(text)
    ordered = om._ordered

    def apart(hashes, place, low):
        upper = hashes >> np.uint64(om._PLACE)
        order = np.lexsort((place, upper))
        return upper[order], place[order]

    monkeypatch.setattr(om, "_ordered", apart)
    assert om.OrderMinHash().fingerprint(text) == want
    monkeypatch.setattr(om, "_ordered", ordered)
    assert om.OrderMinHash().fingerprint(b"ab " * 400_000) != want  # over 2**20 places


def test_occurrences_count():
    """A passage that stands twice is not one that stands once."""
    scheme = om.OrderMinHash()
    passage = sentence(random.Random(6), 60).encode()
    assert 0.05 < om.likeness(scheme.parts(passage), scheme.parts(passage + passage)) < 0.95
    assert om.likeness(scheme.parts(b""), scheme.parts(b"")) == 1.0 and om.likeness(scheme.parts(b""), scheme.parts(b"a")) == 0.0
