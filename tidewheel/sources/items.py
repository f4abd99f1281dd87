"""Item schemas, readers, and the stand-in items over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The work-item record; nulls mean unknown, which is never the same as empty or false.
ITEM_DDL = (
    "item_id string not null, type string, number bigint, repo string, title string, body string, state string, author string,"
    " author_is_bot boolean, created_at timestamp, updated_at timestamp, closed_at timestamp, labels array<string>, ci_status string,"
    " review_count int, additions int, deletions int, changed_files int, has_tests boolean, node_id string, head_ref_oid string,"
    " closes_issues array<bigint>, body_length int, full_body string"
)
#: ``text_key`` tells which text a vector was made of; null: unknown.
EMBEDDING_DDL = "item_id string not null, embedding array<float>, embedding_space string, text_key string"
DIFF_DDL = "number bigint, repo string, patch_text string, fetched_at timestamp"
REVIEW_DDL = (
    "number bigint, repo string, type string, provider string, model string, summary string, concerns array<string>,"
    " recommendation string, confidence double, reviewed_at timestamp"
)
AUTHOR_DDL = "author string, repo string, merge_count int, cached_at timestamp"
#: What an event asks to be done elsewhere, once: ``delivered_at`` is null until it was.
INTENT_DDL = "event_id bigint, action string, item_id string, target string, similarity double, text string, delivered_at timestamp"
#: Metadata kept as one JSON column in stores of the older layout.
METADATA_DDL = (
    "author string, authorIsBot boolean, state string, closedAt string, labels array<string>, ciStatus string, reviewCount int,"
    " additions int, deletions int, changedFiles int, hasTests boolean, nodeId string, headRefOid string, closesIssues array<bigint>, bodyLength int"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the columns of a schema; those that it lacks are null."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])


def items_of(store: DataFrame, repos: list[str] | None = None) -> DataFrame:
    """Items of some repositories; the filter reaches the scan, metadata JSON is parsed with a fixed schema."""
    kept = store if repos is None else store.filter(F.col("repo").isin(repos))
    if "metadata_json" not in kept.columns:
        return kept
    m = F.from_json("metadata_json", METADATA_DDL)
    return kept.withColumn("m", m).select(
        *[c for c in kept.columns if c != "metadata_json"],
        F.col("m.author").alias("author"), F.col("m.authorIsBot").alias("author_is_bot"), F.col("m.state").alias("state"),
        F.to_timestamp("m.closedAt").alias("closed_at"), F.col("m.labels").alias("labels"), F.col("m.ciStatus").alias("ci_status"),
        F.col("m.reviewCount").alias("review_count"), F.col("m.additions").alias("additions"), F.col("m.deletions").alias("deletions"),
        F.col("m.changedFiles").alias("changed_files"), F.col("m.hasTests").alias("has_tests"), F.col("m.nodeId").alias("node_id"),
        F.col("m.headRefOid").alias("head_ref_oid"), F.col("m.closesIssues").alias("closes_issues"), F.col("m.bodyLength").alias("body_length"),
    )


def vectors_of(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(item_id, embedding)`` of items that have a vector."""
    return embeddings.join(items.select("item_id"), "item_id").select("item_id", "embedding")


_STAND_IN = """
SELECT concat(repo, ':', type, ':', CAST(number AS STRING)) AS item_id, * FROM (
 SELECT d.doc_id AS number,
  CASE WHEN d.doc_id % 3 = 0 THEN 'issue' ELSE 'pr' END AS type,
  concat('org/r', CAST(d.doc_id % 2 AS STRING)) AS repo,
  substr(d.text, 1, 60) AS title, substr(d.text, 1, 500) AS body, CAST(d.n_chars AS INT) AS body_length,
  CASE WHEN d.doc_id % 4 = 1 THEN 'closed' WHEN d.doc_id % 4 = 2 AND d.doc_id % 3 <> 0 THEN 'merged' ELSE 'open' END AS state,
  CASE WHEN d.doc_id % 29 = 0 THEN 'dependabot' ELSE concat('user', CAST(d.doc_id % 17 AS STRING)) END AS author,
  CAST(NULL AS BOOLEAN) AS author_is_bot,
  {ts} + (d.doc_id * 37 % 1000) * INTERVAL '1' HOUR AS created_at,
  {ts} + (d.doc_id * 37 % 1000) * INTERVAL '1' HOUR + (d.doc_id % 60) * INTERVAL '1' DAY AS updated_at,
  CASE WHEN d.doc_id % 4 = 1 OR (d.doc_id % 4 = 2 AND d.doc_id % 3 <> 0)
    THEN {ts} + (d.doc_id * 37 % 1000) * INTERVAL '1' HOUR + 5 * INTERVAL '1' DAY END AS closed_at,
  CASE d.doc_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'pending' WHEN 3 THEN 'unknown' END AS ci_status,
  CAST(d.doc_id % 6 AS INT) AS review_count,
  CASE WHEN d.doc_id % 7 <> 0 THEN CAST(d.n_chars % 900 AS INT) END AS additions,
  CASE WHEN d.doc_id % 7 <> 0 THEN CAST(d.n_chars % 300 AS INT) END AS deletions,
  CASE d.doc_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS has_tests,
  {sha} AS head_ref_oid,
  CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 11 = 0 THEN NULL
       WHEN d.doc_id % 2 = 1 THEN {empty}
       ELSE {series} END AS closes_issues
 FROM documents d) t
"""

STAND_IN_SPARK = _STAND_IN.format(
    ts="TIMESTAMP '2024-01-01 00:00:00'",
    sha="sha2(d.text, 256)",
    empty="CAST(array() AS ARRAY<BIGINT>)",
    series="sequence(6 * (d.doc_id % 5) % 15, CAST(1998 AS BIGINT), CAST(15 AS BIGINT))",
)
STAND_IN_DUCKDB = _STAND_IN.replace("STRING", "VARCHAR").format(
    ts="TIMESTAMP '2024-01-01 00:00:00'",
    sha="sha256(d.text)",
    empty="CAST([] AS BIGINT[])",
    series="generate_series(6 * (d.doc_id % 5) % 15, 1998, 15)",
)


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in items with their whole text as ``full_body``."""
    whole = STAND_IN_SPARK.replace("FROM documents d", ", d.text AS full_body FROM {docs} d")
    return spark.sql(whole, docs=read_table(spark, sf_dir, "documents"))


def stand_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items over all of ``documents``, and the vectors of those that have one, ``(item_id, embedding)``."""
    items = spark.sql(STAND_IN_SPARK.replace("documents d", "{docs} d"), docs=read_table(spark, sf_dir, "documents"))
    named = items.select("item_id", F.col("number").alias("vec_id"))
    return items, read_table(spark, sf_dir, "embeddings").join(named, "vec_id").select("item_id", "embedding")
