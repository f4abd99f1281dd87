"""The registered queries and the pipeline on the smallest tables, and the pipeline's stages against plain versions."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm import brute
from tidewheel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = docs = stage(spark, docs, SF).persist()
        assert name == "byte_bpe" or docs.columns == columns
    clean = {r["doc_id"]: r["text"] for r in frames["toxicity"].collect()}
    assert set(clean) <= set(before) and len(clean) > 0.7 * len(before)
    groups = brute.components(list(clean.items()), 5, 80)
    kept = {r["doc_id"]: r["text"] for r in frames["ngram_jaccard"].collect()}
    assert set(kept) == {i for i, (_, c) in groups.items() if c == i}
    cut = {i: k.decode("utf-8", "ignore") for i, _, _, k in brute.removed(list(kept.items()), 50)}
    got = {r["doc_id"]: r for r in frames["suffix_array"].collect()}
    assert {i: r["text"] for i, r in got.items()} == cut and all(r["n_chars"] == len(r["text"]) for r in got.values())
    mixed = frames["mixing"].collect()
    assert all(cut[r["doc_id"]] == r["text"] for r in mixed)
    assert sum(r["n_tokens"] > 0 for r in frames["byte_bpe"].collect()) == sum(bool(r["text"]) for r in mixed)
    for f in frames.values():
        f.unpersist()


def test_run_and_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if q.startswith("op")))
def test_every_query_covers_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in ("op5_topk_search", "op6_mixing", "op3_chat_format", "op12_collocations"):
        assert df.count() > 0
    else:
        table = {"op8_url_filter": "pages", "op11_centroid_clustering": "embeddings"}.get(name, "documents")
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
