"""Digests: what is new in a week, the largest clusters, backlog reports. Few rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import clean_title
from tidewheel.operators.stats import items_since

#: Rows that reports show: clusters of a digest, clusters and members of details, off-vision items and their details.
TOP_CLUSTERS, DETAILS, MEMBERS, OFF_VISION, OFF_VISION_DETAILS = 5, 20, 15, 20, 50


def digest_totals(items: DataFrame, clusters: DataFrame, members: DataFrame, since) -> DataFrame:
    """One row: repositories, items, items since a moment, clusters and items in them, summed over repositories."""
    new = items_since(items, since).agg(F.coalesce(F.sum("new_items"), F.lit(0)).alias("new_items"))
    size = items.agg(F.count_distinct("repo").alias("repos"), F.count("*").alias("items"))
    found = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("in_clusters"))
    across = members.groupBy("cluster_id").agg(F.count_distinct("repo").alias("n")).agg(F.count_if(F.col("n") > 1).alias("across_repos"))
    one = F.lit(1).alias("k")
    out = size.select(one, "*")
    for part in (new, found, across):
        out = out.join(part.select(one, "*"), "k")
    return out.drop("k")


def top_members(members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """``(cluster_id, shown, more)``: references of each cluster's best members, and how many are left out."""
    # every task sends its first few of a cluster, so no task has a whole one
    order = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "item_id"))
    best = members.select("cluster_id", "score", "item_id").withColumn("__n", order).filter(F.col("__n") <= most)
    listed = best.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("__n", "item_id"))).alias("all"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return listed.join(sizes, "cluster_id").select("cluster_id", F.transform("all", lambda x: x["item_id"]).alias("shown"), F.greatest(F.col("size") - most, F.lit(0)).cast("int").alias("more"))


def clusters_of(members: DataFrame, repo: str, number: int, kind: str = "pr") -> DataFrame:
    """Ids of the clusters that an item is in."""
    return members.filter((F.col("repo") == repo) & (F.col("number") == number) & (F.col("type") == kind)).select("cluster_id").distinct()


def off_vision(scores: DataFrame, top: int = OFF_VISION) -> DataFrame:
    """The items furthest from every section."""
    return scores.filter("classification = 'off-vision'").orderBy("score", "item_id").limit(top)


def _cluster_lines(clusters: DataFrame, members: DataFrame, top: int) -> list[str]:
    rows = clusters.orderBy("cluster_id").limit(top).join(top_members(members), "cluster_id").orderBy("cluster_id")
    shown = rows.select("cluster_id", "size", F.round(100 * F.col("avg_similarity"), 1).alias("percent"), clean_title(F.col("theme"), 80).alias("theme"), "shown", "more").collect()
    out = []
    for r in shown:
        rest = f" and {r['more']} more" if r["more"] else ""
        out.append(f"{r['cluster_id']}. {r['theme']}: {r['size']} items, {r['percent']} % alike ({', '.join(r['shown'])}{rest})")
    return out


def weekly_digest(items: DataFrame, clusters: DataFrame, members: DataFrame, since) -> str:
    """What a week brought: totals, then the largest clusters."""
    t = digest_totals(items, clusters, members, since).first()
    head = ["# Week in review", "", f"{t['new_items']} new of {t['items']} items in {t['repos']} repositories; {t['in_clusters']} stand in {t['clusters']} clusters, {t['across_repos']} of them across repositories."]
    return "\n".join([*head, "", "## Largest clusters", "", *_cluster_lines(clusters, members, TOP_CLUSTERS)]) + "\n"


def backlog_report(scans: list, clusters: DataFrame, members: DataFrame) -> str:
    """What a scan of the backlog did, and the clusters that it leaves. ``scans``: ``ScanReport`` of each repository."""
    lines = ["# Backlog", "", *(f"- {x}" for s in scans for x in s.lines()), "", "## Clusters", ""]
    return "\n".join([*lines, *_cluster_lines(clusters, members, DETAILS)]) + "\n"
