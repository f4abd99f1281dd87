"""Confirmed duplicates: pull requests with one head commit, or with one normalised diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.mapping import is_bot
from tidewheel.functions.scoring import cluster_score
from tidewheel.functions.text import diff_fingerprint
from tidewheel.operators.ordering import numbered


def confirmed(items: DataFrame, diffs: DataFrame | None = None, include_bots: bool = False, bot_logins: tuple[str, ...] = ()) -> DataFrame:
    """Members of confirmed groups: item columns, score, basis, key and cluster_id (from 0, head commits first).

    Groups of one commit claim their pull requests before diffs are looked at. Group sizes come from partial
    counts, so one very common key costs no more than its rows.
    """
    prs = items.filter(F.col("type") == "pr")
    if not include_bots:
        prs = prs.filter(~is_bot(F.col("author"), F.col("author_is_bot"), bot_logins))
    prs = prs.withColumn("score", cluster_score())
    by_head = _groups(prs.filter(F.coalesce("head_ref_oid", F.lit("")) != "").withColumn("key", F.col("head_ref_oid")), "head-oid")
    found = by_head
    if diffs is not None:
        left = prs.join(by_head.select("repo", "number"), ["repo", "number"], "left_anti")
        printed = left.join(diffs.select("repo", "number", diff_fingerprint(F.col("patch_text")).alias("key")), ["repo", "number"])
        found = by_head.unionByName(_groups(printed.filter("key is not null"), "patch-id").select(by_head.columns))
    keys = found.select("basis", "key").distinct()
    return found.join(numbered(keys, ["basis", "key"], "cluster_id", start=0), ["basis", "key"])


def _groups(rows: DataFrame, basis: str) -> DataFrame:
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2").select("key")
    return rows.join(keys, "key").withColumn("basis", F.lit(basis))
