"""Blocks of op5's index hold documents that share words, and exact scores are sums in the order of words."""

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import topk_search


def test_blocks_hold_documents_of_one_language():
    """128 documents of two languages in turn, each with a commonest word: a block has the words of one, so the other's queries skip it."""
    n, per, words = 128, 10, 40
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(n), per)
    term = np.concatenate([np.append(0, np.sort(1 + rng.choice(words // 2 - 1, per - 1, replace=False))) + (k % 2) * (words // 2) for k in range(n)])
    asked = [np.arange(words // 2), np.arange(words // 2, words)]
    weights = [rng.random(words // 2) for _ in asked]
    queries = topk_search.Queries([7, 8], asked, weights, words, np.bincount(term, minlength=words))
    tf = np.where(term % (words // 2) == 0, 9, rng.integers(1, 6, len(doc)))
    index = topk_search.PieceIndex(np.arange(n) + 1000, doc, term, tf, np.full(n, 50), 50.0, queries)
    bound = index.bounds(queries)
    assert ((bound > 0).sum(axis=1) == 1).all()
    best = topk_search.TopK(2, 5)
    index.search(queries, best)
    assert not queries.by_word.any()
    for q in range(2):
        score = np.zeros(n)
        for d, t, f in zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True):
            if t in asked[q]:
                score[d] += weights[q][t - asked[q][0]] * (f * (topk_search.K1 + 1) / (f + topk_search.K1 * (1 - topk_search.B + topk_search.B * 50 / 50.0)))
        order = np.lexsort((np.arange(n), -score))[:5]
        assert best.id[q].tolist() == (order + 1000).tolist() and best.score[q].tolist() == score[order].tolist()


def _piece(n: int, words: int, seed: int):
    """Cells of random documents in order of document and word, and four queries."""
    rng = np.random.default_rng(seed)
    terms = [np.sort(rng.choice(words, rng.integers(0, 30), replace=False)) for _ in range(n)]
    doc, term = np.repeat(np.arange(n), [len(t) for t in terms]), np.concatenate(terms).astype(np.int64)
    asked = [np.sort(rng.choice(words, 40, replace=False)) for _ in range(4)]
    queries = topk_search.Queries(np.arange(4), asked, [rng.random(40) * 5 for _ in asked], words, np.bincount(term, minlength=words))
    return (np.arange(n) + 1, doc, term, rng.integers(1, 9, len(doc)), np.full(n, 40), 40.0), queries


def _all_scores(cells, queries) -> np.ndarray:
    (ids, doc, term, tf, length, mean), out = cells, np.zeros((len(cells[0]), len(queries.ids)))
    for d, t, f in zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True):
        for q, (has, weight) in enumerate(zip(queries.terms, queries.weights, strict=True)):
            out[d, q] += weight[has == t].sum() * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / mean)))
    return out


def test_postings_add_up_in_parts(monkeypatch):
    """Blocks scored together, postings a few at a time and words beyond the dense ones give every score; bounds reach them all."""
    monkeypatch.setattr(topk_search, "DENSE", 5)
    monkeypatch.setattr(topk_search, "PAIRS", 16)
    cells, queries = _piece(700, 200, 5)
    index = topk_search.PieceIndex(*cells, queries)
    scores = _all_scores(cells, queries)[index.ids - 1]
    for who in (np.arange(4), np.array([1, 3])):
        assert np.allclose(index.scores(3, 11, who, queries), scores[96:352][:, who], rtol=1e-5)
    assert np.allclose(index.scores(16, index.blocks, np.arange(4), queries), scores[512:], rtol=1e-5)
    bound = index.bounds(queries)
    assert all((bound[b] >= scores[b * 32 : b * 32 + 32].max(axis=0) * (1 - 1e-5)).all() for b in range(index.blocks))


def test_known_floor_spares_what_cannot_be_found():
    """From the k-th best of other documents on, a shard tells only what reaches it, and tells all of that."""
    cells, queries = _piece(700, 200, 6)
    index, scores = topk_search.PieceIndex(*cells, queries), _all_scores(cells, queries)
    floor = np.sort(scores, axis=0)[-4]
    best = topk_search.TopK(4, 10, floor * (1 - 1e-12))
    index.search(queries, best)
    assert np.isfinite(best.score).sum(axis=1).tolist() == [4] * 4
    for q in range(4):
        assert best.id[q, :4].tolist() == (np.lexsort((np.arange(700), -scores[:, q]))[:4] + 1).tolist()


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(2)
    terms = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), np.arange(5, 40, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
    asked = np.concatenate([terms[::-1], terms + np.uint64(1), np.arange(50, dtype=np.uint64)])
    place = {int(t): k for k, t in enumerate(terms)}
    assert topk_search.Vocabulary(terms).find(asked).tolist() == [place.get(int(w), -1) for w in asked]
    assert topk_search.Vocabulary(terms[:0]).find(asked).tolist() == [-1] * len(asked)


def test_first_search_of_a_few_documents_changes_nothing(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 20), i -> concat('w', pmod(xxhash64(id, i), 150))))").alias("text"))
    asked = docs.filter("doc_id % 50 = 0")
    want = topk_search.search(docs, asked, k=5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(topk_search, "FIRST_FROM", 100)
    monkeypatch.setattr(topk_search, "FIRST_DOCS", 60)
    assert topk_search.search(docs, asked, k=5).orderBy("query_id", "rank").collect() == want
