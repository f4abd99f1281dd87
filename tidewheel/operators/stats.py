"""Aggregations: repositories, coverage, vision, clusterings, digests, authors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.components import checkpointed, connected_components


def repo_stats(items: DataFrame, diffs: DataFrame | None = None, repos: list[str] | None = None) -> DataFrame:
    kept = items if repos is None else items.filter(F.col("repo").isin(repos))
    out = kept.groupBy("repo").agg(
        F.count("*").alias("items"), F.count_if(F.col("type") == "pr").alias("prs"), F.count_if(F.col("type") == "issue").alias("issues")
    )
    if diffs is None:
        return out
    return out.join(diffs.groupBy("repo").agg(F.count("*").alias("diffs")), "repo", "left").fillna(0, ["diffs"])


def coverage(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items with a vector, all items, and the rounded percentage, by repository."""
    have = vectors.select("item_id").distinct().withColumn("v", F.lit(1))
    joined = items.join(have, "item_id", "left")
    return joined.groupBy("repo").agg(F.count("v").alias("embedded"), F.count("*").alias("total")).withColumn(
        "percent", F.floor(100 * F.col("embedded") / F.col("total") + 0.5).cast("int")
    )


def repo_status(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items, real vector count and last update by repository."""
    have = vectors.select("item_id").distinct().withColumn("v", F.lit(1))
    return items.join(have, "item_id", "left").groupBy("repo").agg(
        F.count("*").alias("items"), F.count("v").alias("embeddings"), F.max("updated_at").alias("last_sync")
    )


def vision_distribution(scores: DataFrame) -> DataFrame:
    total = Window.partitionBy()
    counted = scores.groupBy("classification").agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(total), 1))


def vision_sections(scores: DataFrame, top: int = 15) -> DataFrame:
    return (
        scores.groupBy("section")
        .agg(
            F.count_if(F.col("classification") == "aligned").alias("aligned"),
            F.count_if(F.col("classification") == "drifting").alias("drifting"),
            F.count_if(F.col("classification") == "off-vision").alias("off_vision"),
            F.count("*").alias("total"),
        )
        .orderBy(F.desc("total"), "section")
        .limit(top)
    )


def duplicate_share(clusters: DataFrame, total_items: int) -> DataFrame:
    """Clusters, items in them, their share, and the percentage cut to one decimal."""
    out = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("duplicates"))
    ratio = F.lit(0.0) if total_items == 0 else F.col("duplicates") / total_items
    cut = F.lit(0.0) if total_items == 0 else F.floor(F.col("duplicates") * 1000 / total_items) / 10
    return out.withColumn("share", ratio).withColumn("percent", cut)


def author_frequency(items: DataFrame, top: int = 50) -> DataFrame:
    known = items.filter(F.coalesce("author", F.lit("")).isin("", "unknown") == F.lit(False))
    return known.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(top)


def merge_counts(items: DataFrame, top_only: bool = False) -> DataFrame:
    """``(repo, author, merge_count)`` from merged items; ``top_only`` keeps the fifty most frequent authors."""
    merged = items.groupBy("repo", "author").agg(F.count_if(F.col("state") == "merged").cast("int").alias("merge_count"))
    return merged.join(F.broadcast(author_frequency(items).select("author")), "author", "left_semi") if top_only else merged


def fresh_authors(cache: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Cached merge counts that have not expired."""
    return cache.filter(F.unix_millis("cached_at") > F.unix_millis(F.lit(as_of)) - hours * 3_600_000)


def cross_repo(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count_distinct("repo").alias("repos")).filter("repos > 1")


def large_groups(clusters: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    return clusters.filter(F.col("size") >= least).orderBy("cluster_id").limit(top)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rounded Jaccard percentage of the items of two clusterings; two empty ones agree, one empty does not."""
    left, right = a.select("item").distinct().withColumn("a", F.lit(1)), b.select("item").distinct().withColumn("b", F.lit(1))
    n = left.join(right, "item", "full").agg(F.count(F.expr("a + b")).alias("both"), F.count("*").alias("any"), F.count("a").alias("na"), F.count("b").alias("nb"))
    return n.select(F.when((F.col("na") == 0) & (F.col("nb") == 0), 100).when((F.col("na") == 0) | (F.col("nb") == 0), 0).otherwise(F.floor(100 * F.col("both") / F.col("any") + 0.5)).cast("int").alias("overlap_percent"))


def cluster_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of clusters of two clusterings that share items, with their Jaccard similarity."""
    a, b = a.select("id", "item").distinct(), b.select("id", "item").distinct()
    sa = a.groupBy("id").agg(F.count("*").alias("na")).withColumnRenamed("id", "id_a")
    sb = b.groupBy("id").agg(F.count("*").alias("nb")).withColumnRenamed("id", "id_b")
    common = a.withColumnRenamed("id", "id_a").join(b.withColumnRenamed("id", "id_b"), "item").groupBy("id_a", "id_b").agg(F.count("*").alias("n"))
    return common.join(sa, "id_a").join(sb, "id_b").select("id_a", "id_b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("overlap"))


#: Pairs of a component up to which one task settles it.
ONE_TASK_PAIRS = 1_000_000


def greedy_matches(pairs: DataFrame, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """Each cluster at most once, best overlap first, ties to the smaller ids.

    What the greedy order takes in one component of the pair graph says nothing about another, so each is settled where
    its pairs lie sorted, in one pass. Components of more pairs than ``one_task_pairs`` go in rounds.
    """
    left = checkpointed(pairs)
    ends = left.select(F.concat(F.lit("a "), F.col("id_a").cast("string")).alias("a"), F.concat(F.lit("b "), F.col("id_b").cast("string")).alias("b"))
    parts = connected_components(ends, one_task_edges=100_000).filter("id like 'a %'").select(F.col("id").alias("__a"), "component")
    placed = checkpointed(left.withColumn("__a", F.concat(F.lit("a "), F.col("id_a").cast("string"))).join(parts, "__a").drop("__a"))
    large = checkpointed(placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > one_task_pairs).select("component"))
    schema = left.select("id_a", "id_b", "overlap").schema

    def run(batches):
        now, used = None, (set(), set())
        for batch in batches:
            rows = []
            for component, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if component != now:
                    now, used = component, (set(), set())
                rows.append(a not in used[0] and b not in used[1])
                if rows[-1]:
                    used[0].add(a)
                    used[1].add(b)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], ["id_a", "id_b", "overlap"]).filter(pa.array(rows, pa.bool_()))

    keys = ["component", F.desc("overlap"), "id_a", "id_b"]
    small = placed.join(large, "component", "left_anti").repartition("component").sortWithinPartitions(*keys).select("component", "id_a", "id_b", "overlap")
    out = small.mapInArrow(run, schema).unionByName(_matched_in_rounds(placed.join(large, "component", "left_semi").select("id_a", "id_b", "overlap")))
    return out.select("id_a", "id_b", F.floor(100 * F.col("overlap") + 0.5).cast("int").alias("overlap"))


def _matched_in_rounds(pairs: DataFrame) -> DataFrame:
    """Greedy matches of pairs, whole rounds at a time.

    A pair that is best for both its clusters is what the greedy order takes first among its neighbours, so
    each round takes all of those at once and drops what they use, until no pair is left. The best pair of all is
    always best for both, so every round takes one at least.
    """
    left, out = checkpointed(pairs), pairs.limit(0)
    while not left.isEmpty():
        keyed = left.withColumn("k", F.struct((-F.col("overlap")).alias("o"), "id_a", "id_b"))
        first_a, first_b = (keyed.groupBy(c).agg(F.min("k").alias("m")) for c in ("id_a", "id_b"))
        best = first_a.join(first_b.withColumnRenamed("m", "n"), F.col("m") == F.col("n"))
        taken = checkpointed(best.select("m.id_a", "m.id_b", (-F.col("m.o")).alias("overlap")))
        out = out.unionByName(taken)
        left = checkpointed(left.join(taken.select("id_a"), "id_a", "left_anti").join(taken.select("id_b"), "id_b", "left_anti"))
    return out


def unmatched(clusters_of: DataFrame, matches: DataFrame, side: str) -> int:
    """How many clusters of one side (``id_a`` or ``id_b``) no match has; ``clusters_of``: (id, item)."""
    return clusters_of.select("id").distinct().join(matches.select(F.col(side).alias("id")), "id", "left_anti").count()


def threshold_sweep(edges: DataFrame, thresholds: list[float], components) -> DataFrame:
    """Components of at least two at each threshold, from edges built once at the lowest."""
    out = None
    for t in thresholds:
        one = components(edges.filter(F.col("sim") >= t)).agg(F.count_distinct("cluster_key").alias("clusters"), F.count("*").alias("items"))
        one = one.withColumn("threshold", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("threshold", "clusters", "items")


def items_since(items: DataFrame, since) -> DataFrame:
    """Items created from a moment on, by repository; digests sum these."""
    return items.filter(F.col("created_at") >= since).groupBy("repo").agg(F.count("*").alias("new_items"))


def throughput(items: int, seconds: float) -> int:
    return int(items / seconds * 60 + 0.5) if seconds > 0 else 0


def dimension_study(a: DataFrame, b: DataFrame, best_a: DataFrame, best_b: DataFrame, top: int = 20) -> dict:
    """How two clusterings of one corpus differ: counts, mean sizes, membership overlap, agreement of picks.

    ``a``, ``b``: (id, item); ``best_*``: (id, size, theme, canonical). The best picks of the ``top`` largest
    clusters are matched on the first forty characters of their themes.
    """
    shape = [x.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("c"), F.avg("n").alias("m")).first() for x in (a, b)]
    jaccard = overlap(a, b).first()[0]
    picks = [x.orderBy(F.desc("size"), "id").limit(top).select(F.substring("theme", 1, 40).alias("theme"), F.col("canonical").alias(c)) for x, c in ((best_a, "p"), (best_b, "q"))]
    agree = picks[0].join(picks[1], "theme").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("same")).first()
    verdict = "equivalent" if jaccard >= 90 else "close" if jaccard >= 80 else "different"
    return {
        "clusters": (shape[0]["c"], shape[1]["c"]), "delta": shape[1]["c"] - shape[0]["c"], "mean_size": (shape[0]["m"], shape[1]["m"]),
        "membership_jaccard": jaccard, "picks": agree["n"], "same_picks": agree["same"], "verdict": verdict,
    }
