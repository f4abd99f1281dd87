"""Operators on inputs that a shortened job gets wrong."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm import brute
from tidewheel.llm import bpe, ngram_join, toxicity


def test_join_keeps_links_of_repeated_rows(spark):
    """A's 20 shingles stand twice or more, B has 18 of them, C and D likewise share 18 of 20."""
    rows = []
    for k in range(8):
        words = [f"w{k}x{j}" for j in range(22)]
        rows += [(2 * k, " ".join(words))] * (2 + k % 3) + [(2 * k + 1, " ".join(words[:20] if k % 2 else words[2:]))]
        rows += [(2 * k, " ".join(words).upper())]
    want = brute.components(rows, 3, 90)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, *want[i]) for i, _ in rows)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(8))


def test_pipeline_tokens_equal_tiktoken_and_decode_back(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["plain words", "größer als\n\n 12345 ", "\u4f60\u597d \U0001f600", "", None]
    docs = spark.createDataFrame([(i, "web", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(own.decode_bytes(ids)).hexdigest() == hashlib.sha256((t or "").encode()).hexdigest()


def test_toxicity_screens_before_it_bounds(spark):
    """Common words of both classes are more than four times the bound; the telling word is rarer than they are."""
    common = " ".join(f"c{j}" for j in range(30))
    docs = [(i, common + (" vile" if i % 2 and i % 4 == 1 else "")) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels, max_features=2)
    assert 1 <= len(model.features) <= 2
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert min(got[i] for i, t in docs if "vile" in t) > max(got[i] for i, t in docs if "vile" not in t)
