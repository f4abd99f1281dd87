"""Quality scores of work items as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Shares of the six signals; the fixed defaults sum to 1."""

    has_tests: float = 0.25
    ci_passing: float = 0.20
    diff_size: float = 0.15
    author_history: float = 0.15
    description: float = 0.15
    reviews: float = 0.10


RECENCY_WEIGHT, HALF_LIFE_DAYS = 0.05, 30.0


def description_quality(length: Column) -> Column:
    n = F.coalesce(length, F.lit(0)).cast("double")
    return (
        F.when(n == 0, 0.0)
        .when(n < 50, 0.1)
        .when(n < 200, 0.3 + (n - 50) / 150 * 0.3)
        .when(n < 1000, 0.6 + (n - 200) / 800 * 0.3)
        .otherwise(0.9 + F.least(F.lit(0.1), (n - 1000) / 5000 * 0.1))
    )


def diff_size(additions: Column, deletions: Column) -> Column:
    total = additions + deletions
    return F.when(total <= 50, 1.0).when(total <= 200, 0.8).when(total <= 500, 0.6).when(total <= 1000, 0.4).when(total <= 5000, 0.2).otherwise(0.1)


def author_history(merges: Column) -> Column:
    m = F.coalesce(merges, F.lit(0)).cast("double")
    return F.when(m == 0, 0.1).when(m <= 5, 0.2 + m * 0.04).when(m <= 20, 0.4 + (m - 5) * 0.02).otherwise(F.least(F.lit(1.0), 0.7 + (m - 20) * 0.005))


def ci_signal(status: Column) -> Column:
    return F.when(status == "success", 1.0).when(status == "failure", 0.0).otherwise(0.5)


def review_signal(count: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / 3.0)


def recency(updated_at: Column, as_of: Column) -> Column:
    """Halves every thirty days, at millisecond precision."""
    age = (F.unix_millis(as_of) - F.unix_millis(updated_at)) / (1000.0 * 60 * 60 * 24)
    return F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)


def rank_signals(as_of: Column, merges: str = "merge_count") -> dict[str, Column]:
    """Signals of the ranking score: a red build forfeits test credit, a missing diff is -1."""
    known = F.col("additions").isNotNull() & F.col("deletions").isNotNull()
    tests = F.when(F.col("has_tests"), F.when(F.col("ci_status") == "failure", 0.0).otherwise(1.0)).when(~F.col("has_tests"), 0.0).otherwise(0.5)
    return {
        "s_tests": tests,
        "s_ci": ci_signal(F.col("ci_status")),
        "s_diff": F.when(known, diff_size(F.col("additions"), F.col("deletions"))).otherwise(-1.0),
        "s_author": author_history(F.col(merges)),
        "s_description": description_quality(F.col("body_length")),
        "s_reviews": review_signal(F.col("review_count")),
        "s_recency": recency(F.col("updated_at"), as_of),
    }


def rank_score(w: Weights = Weights()) -> Column:
    """Weighted sum of the ``s_*`` columns; without diff stats the other weights are scaled to their sum."""
    others = w.has_tests + w.ci_passing + w.author_history + w.description + w.reviews
    scale = F.when(F.col("s_diff") < 0, F.lit(others)).otherwise(F.lit(1.0))
    return (
        F.col("s_tests") * (w.has_tests / scale)
        + F.col("s_ci") * (w.ci_passing / scale)
        + F.greatest(F.col("s_diff"), F.lit(0.0)) * F.when(F.col("s_diff") < 0, 0.0).otherwise(w.diff_size)
        + F.col("s_author") * (w.author_history / scale)
        + F.col("s_description") * (w.description / scale)
        + F.col("s_reviews") * (w.reviews / scale)
        + F.col("s_recency") * RECENCY_WEIGHT
    )


def cluster_score(w: Weights = Weights()) -> Column:
    """Score of a cluster's member: no recency, neutral author and missing diff, full credit for tests."""
    known = F.col("additions").isNotNull() & F.col("deletions").isNotNull()
    return (
        F.when(F.col("has_tests"), 1.0).when(~F.col("has_tests"), 0.0).otherwise(0.5) * w.has_tests
        + ci_signal(F.col("ci_status")) * w.ci_passing
        + F.when(known, diff_size(F.col("additions"), F.col("deletions"))).otherwise(0.5) * w.diff_size
        + description_quality(F.length("body")) * w.description
        + review_signal(F.col("review_count")) * w.reviews
        + F.lit(0.5 * w.author_history)
    )


def state_tier(state: Column, incident_closed: Column) -> Column:
    return (
        F.when(state == "merged", 4)
        .when(state == "open", 3)
        .when((state == "closed") & F.coalesce(incident_closed, F.lit(False)), 2)
        .when(state == "closed", 1)
        .otherwise(0)
    )


def ci_rank(status: Column) -> Column:
    return F.when(status == "failure", 0).otherwise(1)


#: Least similarities from which a cluster is high and solid.
HIGH, SOLID = 0.9, 0.8


def confidence(min_similarity: Column) -> Column:
    """high from 0.9, solid from 0.8, else loose; NaN and null are loose."""
    usable = min_similarity.isNotNull() & ~F.isnan(min_similarity)
    return F.when(usable & (min_similarity >= HIGH), "high").when(usable & (min_similarity >= SOLID), "solid").otherwise("loose")
