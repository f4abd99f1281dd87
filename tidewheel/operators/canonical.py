"""Which member of a cluster is the source of truth, which is the tracker, how members relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scoring import ci_rank, state_tier
from tidewheel.operators.ordering import numbered

TIE_MARGIN, TIE_HOURS = 0.05, 24


def _orders() -> dict[str, Column]:
    """A member's place by report (issue), by state, build and score (pr), and by score alone, as structs of which the least comes first."""
    dated = [F.col("created_at").isNull().alias("undated"), F.col("created_at")]
    told = [F.col("score"), F.col("tier"), F.col("ci")]
    return {
        "issue": F.struct(*dated, (-F.col("score")).alias("s"), "number", "item_id", *told),
        "pr": F.struct(
            (-F.col("tier")).alias("t"), (-F.col("ci")).alias("c"), (-F.col("score")).alias("s"), *dated,
            (-F.coalesce("review_count", F.lit(0))).alias("r"), "number", "item_id", *told,
        ),
        "best": F.struct((-F.col("score")).alias("s"), "item_id", "score"),
    }


def decide(members: DataFrame, mode: str | None = None) -> DataFrame:
    """One row per cluster: mode, canonical, runner_up, contested, margin.

    Clusters with more issues than half are decided by earliest report, others by state, build, score; the
    margin is the gap of the two best scores, whatever the rule.
    """
    closed = F.col("incident_closed") if "incident_closed" in members.columns else F.lit(False)
    rows = members.withColumn("tier", state_tier(F.col("state"), closed)).withColumn("ci", ci_rank(F.col("ci_status")))
    places = rows.select("cluster_id", "type", *[c.alias(k) for k, c in _orders().items()])
    issues = F.count_if(F.col("type") == "issue") * 2 > F.count("*")
    chosen = F.lit(mode) if mode else F.when(issues, "issue").otherwise("pr")
    # the first of each order, then the first of what is left: least values, summed up before anything is shuffled
    first = places.groupBy("cluster_id").agg(chosen.alias("mode"), *[F.min(k).alias(f"{k}1") for k in _orders()])
    left = lambda k: F.when(F.col(f"{k}.item_id") != F.col(f"{k}1.item_id"), F.col(k))
    second = places.join(first, "cluster_id").groupBy("cluster_id").agg(*[F.min(left(k)).alias(f"{k}2") for k in _orders()])

    def seen(n: int) -> Column:
        parts = lambda k: F.struct(*[F.col(f"{k}{n}")[c].alias(c) for c in ("item_id", "score", "created_at", "tier", "ci")])
        there = lambda k: F.when(F.col(f"{k}{n}").isNotNull(), parts(k))
        return F.when(F.col("mode") == "issue", there("issue")).otherwise(there("pr"))

    out = first.join(second, "cluster_id").select("cluster_id", "mode", seen(1).alias("a"), seen(2).alias("b"), (F.col("best1.score") - F.col("best2.score")).alias("margin"))
    a, b = F.col("a"), F.col("b")
    hours = F.abs(F.unix_millis(a["created_at"]) - F.unix_millis(b["created_at"])) <= TIE_HOURS * 3_600_000
    undated = a["created_at"].isNull() & b["created_at"].isNull()
    issue_tie = F.when(undated, True).otherwise(F.coalesce(hours, F.lit(False)))
    pr_tie = (a["tier"] == b["tier"]) & (a["ci"] == b["ci"]) & (a["score"] - b["score"] < TIE_MARGIN)
    contested = F.when(b.isNull(), False).otherwise(F.when(F.col("mode") == "issue", issue_tie).otherwise(pr_tie))
    return out.select("cluster_id", "mode", a["item_id"].alias("canonical"), b["item_id"].alias("runner_up"), contested.alias("contested"), "margin")


def tracker_roles(members: DataFrame) -> DataFrame:
    """Members with role tracker (the earliest issue), fix (PRs) or duplicate, and the order of candidates.

    ``needs_tracker`` holds where a cluster has no issue.
    """
    dated = (F.col("created_at").isNull().alias("undated"), "created_at")
    issue = F.col("type") == "issue"
    earliest = F.min(F.when(issue, F.struct(*dated, (-F.col("score")).alias("s"), "number", "item_id")))
    heads = members.groupBy("cluster_id").agg(earliest["item_id"].alias("__first"), (F.max(issue.cast("int")) == 0).alias("needs_tracker"))
    rows = members.join(heads, "cluster_id").withColumn("role", F.when(F.col("type") == "pr", "fix").when(F.col("item_id") == F.col("__first"), "tracker").otherwise("duplicate"))
    turn = [
        F.col("cluster_id"),
        F.when(F.col("role") == "tracker", 0).when(F.col("role") == "fix", 1).otherwise(2),
        F.when(F.col("role") == "fix", -F.col("score")),
        F.when(F.col("role") != "fix", F.col("created_at")).asc_nulls_last(),
        F.col("number"),
        F.col("item_id"),
    ]
    # numbered over all clusters by ranges, then from each cluster's least number on: a cluster of any size is cut into ranges
    placed = numbered(rows.drop("__first"), turn, "__n")
    least = placed.groupBy("cluster_id").agg(F.min("__n").alias("__least"))
    return placed.join(least, "cluster_id").withColumn("position", F.col("__n") - F.col("__least") + 1).drop("__n", "__least")


def closing_edges(members: DataFrame) -> DataFrame:
    """``(cluster_id, pr, issue)``: closing references between members of one cluster and repository."""
    prs = members.filter("type = 'pr'").select("cluster_id", "repo", F.col("number").alias("pr"), F.explode("closes_issues").alias("issue"))
    issues = members.filter("type = 'issue'").select("cluster_id", "repo", F.col("number").alias("issue")).distinct()
    return prs.join(issues, ["cluster_id", "repo", "issue"]).select("cluster_id", "pr", "issue")


def relations(members: DataFrame) -> DataFrame:
    """``(cluster_id, relation)``: by types, or linked or not; null where a PR's references were never scanned."""
    kinds = members.groupBy("cluster_id").agg(
        F.max((F.col("type") == "pr").cast("int")).alias("prs"),
        F.max((F.col("type") == "issue").cast("int")).alias("issues"),
        F.max(((F.col("type") == "pr") & F.col("closes_issues").isNull()).cast("int")).alias("unknown"),
    )
    linked = closing_edges(members).select("cluster_id").distinct().withColumn("linked", F.lit(1))
    relation = (
        F.when(F.col("issues") == 0, "prs-only")
        .when(F.col("prs") == 0, "issues-only")
        .when(F.col("unknown") == 1, F.lit(None).cast("string"))
        .when(F.col("linked") == 1, "pr-issue-linked")
        .otherwise("pr-issue-unlinked")
    )
    return kinds.join(linked, "cluster_id", "left").select("cluster_id", relation.alias("relation"))


def canonical_similarity(members: DataFrame, decisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each duplicate's similarity with its canonical item; 0 where a vector is missing."""
    from tidewheel.functions.vectors import cosine

    rest = members.select("cluster_id", "item_id").join(decisions.select("cluster_id", "canonical"), "cluster_id").filter("item_id <> canonical")
    own = vectors.select("item_id", F.col("embedding").alias("a"))
    top = vectors.select(F.col("item_id").alias("canonical"), F.col("embedding").alias("b"))
    joined = rest.join(own, "item_id", "left").join(top, "canonical", "left")
    sim = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(cosine(F.col("a"), F.col("b")))
    return joined.select("cluster_id", "canonical", "item_id", sim.alias("sim"))
