"""Odd inputs through every operator and stage, and scores against their plain definition."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewheel.llm import ngram_join, queries, topk_search, toxicity
from tidewheel.llm._text import released

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    same = prose(90)
    rows = [(1, same, "en", "web", len(same)), (1, same, "en", "web", len(same)), (2, same, None, None, None), (3, None, "en", "web", None), (4, "", "en", None, 0)]
    rows += [(5, prose(60_000), "en", "books", None), (None, prose(30), "en", "web", 9), (6, " \n\t ", "en", "web", 4), (7, "\u00e9\u4f60" * 200, "fr", "web", 400)]
    return rows + [(10 + k, prose(70) + ". You MORON, " + prose(9) if k % 4 == 0 else prose(80), "en", "web", 1) for k in range(40)]


def test_stages_take_odd_rows_and_other_columns(spark, tmp_path):
    """Each stage on its own over odd rows with extra, clashing columns: all but the last keep the columns."""
    labels = [(10 + k, int(k % 4 == 0), 1) for k in range(40)] + [(None, 1, 1), (3, None, None), (99, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = {c: F.lit(7) for c in ("kept", "spans", "n_bytes", "score", "offending", "copy", "order_key", "id", "row", "__row", "__id", "component_id", "n")}
    docs = spark.createDataFrame(odd_rows(), DDL).withColumns(clash)
    ids = sorted(str(r[0]) for r in odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "byte_bpe":
            assert sorted(str(r["doc_id"]) for r in got) == ids
        else:
            assert out.columns == docs.columns, name
            assert {str(r["doc_id"]) for r in got} <= set(ids) and all(r["row"] == 7 and r["__id"] == 7 for r in got)
        if name == "ngram_jaccard":
            assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows()} - {2}
        if name == "suffix_array":
            assert {r["doc_id"]: r["text"] for r in got}[2] == "" and len(got) == len(ids)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    labels = [(10 + k, int(k % 4 == 0), 1) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(odd_rows(), DDL).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_toxicity_score_is_noisy_or(spark):
    """Scores from the model's own weights, sentence by sentence, in plain Python."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["bad", "badly", "good", "fine", "worse"]) + rng.choice(["", ".", "!", "\n"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += ["", "...", "bad"]
    words = ["bad", "badly", "good", "fine", "worse"]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], ["text"])
    from tidewheel.llm._text import Slice

    _, _, found = toxicity._features(Slice(batch, "text"))
    hashes = found[0][1]
    order = np.argsort(hashes)
    weight = dict(zip(words, [2.0, 0.5, -1.0, 0.0, 3.0], strict=True))
    model = toxicity.Model(hashes[order], np.array([weight[words[i]] for i in order]), -2.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        sentences = [s for s in (brute.ALNUM.findall(p) for p in re.split("[.!?\n]", t)) if s] or [[]]
        quiet = math.prod(1 - 1 / (1 + math.exp(2.0 - sum(weight[w] for w in set(s)))) for s in sentences)
        assert got[i] == pytest.approx(1 - quiet, abs=1e-12)


def test_toxicity_query_columns(spark, tmp_path):
    import zlib

    labels = [(10 + k, int(k % 4 == 0), 1) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(odd_rows(), DDL).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] is held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_search_ties_repeats_and_many_short_queries(spark):
    rows = [(k, "alpha beta") for k in (9, 4, 7, 1)] + [(2, "alpha"), (2, "alpha"), (3, None), (None, "alpha"), (5, "gamma " * 50_000), (6, "gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash"))
    got = topk_search.search(df, df.filter("doc_id in (1, 2, 3)"), k=3).collect()
    best = {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert best[1] == [1, 4, 7] and best[2][:2] == [2, 2] and best[3] == []
    many = spark.range(3000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string")).alias("text"))
    found = topk_search.search(many, many, k=1, block_queries=700)
    assert found.count() == 3000 and found.filter("doc_id <> 100 + (query_id - 100) % 50").count() == 0


def test_text_ids_are_refused(spark):
    df = spark.createDataFrame([("a", "b c d")], "doc_id string, text string")
    for run in (lambda: ngram_join.jaccard_components(df), lambda: topk_search.search(df, df)):
        with pytest.raises(TypeError, match="integer"):
            run()


def test_results_travel_in_small_batches(monkeypatch):
    from tidewheel.llm import _text

    monkeypatch.setattr(_text, "RETURN_BYTES", 1000)
    whole = pa.RecordBatch.from_arrays([pa.array([b"x" * 100] * 95)], ["a"])
    sent = list(released(lambda batches: iter(batches))([whole, whole.slice(0, 0)]))
    assert sum(b.num_rows for b in sent) == 95 and len(sent) > 8


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if q.startswith("op")))
def test_queries_take_empty_tables(spark, tmp_path, name):
    """Every registered query over tables without a row gives no row."""
    for table in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
