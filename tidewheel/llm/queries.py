"""Registered queries of this subpackage: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, chat_format, collocations, kdtree_clusters, license_scan, mixing, ngram_join, order_minhash, quality_rules, suffix_dedup, topk_search, toxicity, url_filter

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90, links=True)
    return out.withColumnRenamed("id", "doc_id")


#: Exact, and quadratic in the documents that share a shingle.
ORACLES["op2_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a AS x, a AS y FROM ways UNION SELECT r.x, ways.b FROM reach r JOIN ways ON ways.a = r.y),
parts AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
links AS (SELECT a AS doc_id, count(*) AS n_links FROM ways GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(parts.component_id, s.doc_id) AS component_id,
  coalesce(links.n_links, 0)::BIGINT AS n_links FROM s LEFT JOIN parts USING (doc_id) LEFT JOIN links USING (doc_id)
"""


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(toxicity.fold("doc_id") != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "order_key")


ORACLES["op6_mixing"] = mixing.ORACLE


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        quality_rules.judge(docs, rules)
        .select("doc_id", *[F.col(f"m.{c}").alias(c) for c in counts], "rule")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, known=license_scan.templates()).drop("text", "matches")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), url_filter.RULES, url_filter.page_outcomes(pages)).drop("url")


ORACLES["op8_url_filter"] = url_filter.oracle()


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.swapped_replies(table(spark, sf_dir, "conversations"))
    out = chat_format.preference_format(pairs)

    def seen(side: str):
        return F.aggregate(f"{side}_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias(f"{side}_trainable")

    return out.select(F.col("id").alias("conv_id"), "prompt_turns", "prompt", "chosen", seen("chosen"), "rejected", seen("rejected"))


ORACLES["op3_chat_format"] = chat_format.ORACLE


@query
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return topk_search.search(docs, docs.filter(F.col("doc_id") % 100 == 0), k=10).withColumn("score", F.round("score", 6))


#: Scores every pair of query and document that share a word.
ORACLES["op5_topk_search"] = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS c FROM words GROUP BY doc_id, w),
size AS (SELECT doc_id, sum(c) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, greatest(1.0, (SELECT coalesce(sum(n), 0) FROM size)::DOUBLE / (SELECT count(*) FROM documents)) AS mean),
df AS (SELECT w, count(*) AS n FROM tf GROUP BY w),
asked AS (SELECT tf.doc_id, tf.w, ln(1 + (docs - df.n + 0.5) / (df.n + 0.5)) * 8 * tf.c / (7 + tf.c) AS weight FROM tf JOIN df USING (w), whole WHERE tf.doc_id % 100 = 0),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(q.weight * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * s.n / mean))) AS score
  FROM asked q JOIN tf d USING (w) JOIN size s ON s.doc_id = d.doc_id, whole GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdtree_clusters.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))


ORACLES["op11_centroid_clustering"] = kdtree_clusters.oracle()


@query
def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, inside=50)


ORACLES["op12_collocations"] = collocations.oracle()
