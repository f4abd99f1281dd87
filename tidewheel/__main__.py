"""Commands over a store: ``python -m tidewheel --store PATH COMMAND``.

Results go to stdout as line JSON or markdown; nothing is written to any service. ``scan`` and ``triage`` read
records through a transport (``module:function``, see ``tidewheel.sources.api``) or a folder of event files, and write
to the store only. ``reset`` needs ``--yes``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import mapping, scoring
from tidewheel.functions.text import clean_title, week_start
from tidewheel.functions.vectors import truncate
from tidewheel.operators import clusters, identity, routing, similarity, stats, vision
from tidewheel.operators.canonical import decide
from tidewheel.operators.components import checkpointed
from tidewheel.plans import digest, export
from tidewheel.sources import config, ingest, reviews
from tidewheel.sources import scan as scanning
from tidewheel.sources.api import ItemPages
from tidewheel.sources.store import GEOMETRY, Store
from tidewheel.streaming import triage


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidewheel").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def items_of(store: Store, settings: config.Config) -> DataFrame:
    """Items of the configured repositories with their incident mark, which is derived when read."""
    items = store.read("items")
    items = items.filter(F.col("repo").isin(settings.repos)) if settings.repos else items
    return items.withColumn("incident_closed", mapping.incident_closed(F.col("state"), F.col("closed_at"), settings.windows))


def dupes(store: Store, settings: config.Config, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    store.guard()
    t = settings.thresholds.duplicate if threshold is None else threshold
    return clusters.find_clusters(items_of(store, settings), store.read("embeddings").select("item_id", "embedding"), t, settings.include_bots, settings.bot_logins)


def rank(store: Store, settings: config.Config, as_of: datetime) -> DataFrame:
    items = items_of(store, settings)
    cached = stats.fresh_authors(store.read("author_stats"), as_of).select("repo", "author", F.col("merge_count").alias("cached"))
    counted = items.join(stats.merge_counts(items), ["repo", "author"], "left").join(cached, ["repo", "author"], "left")
    merged = counted.withColumn("merge_count", F.coalesce("cached", "merge_count")).drop("cached")
    scored = merged.withColumns(scoring.rank_signals(F.lit(as_of))).withColumn("score", scoring.rank_score(settings.weights))
    return scored.orderBy(F.desc("score"), "repo", "type", "number")


def alignment(store: Store, settings: config.Config, path: str, provider: ingest.EmbeddingProvider) -> DataFrame:
    """Items against the sections of a vision document."""
    document = vision.read_document(store.spark, path).withColumn("doc", F.lit(path)).select("doc", "text")
    parts = vision.embedding_inputs(document).withColumn("item_id", F.col("idx").cast("string"))
    made = ingest.embed(parts.select("item_id", F.col("input").alias("title"), F.lit("").alias("body")), provider, text="body")
    sections = parts.join(made, "item_id").select("idx", "heading", "embedding")
    vectors = store.read("embeddings").join(items_of(store, settings).select("item_id"), "item_id", "left_semi")
    t = settings.thresholds
    return similarity.best_section(vectors.select("item_id", "embedding"), sections, t.aligned, t.drifting).orderBy(F.desc("score"), "item_id")


def contract(store: Store, settings: config.Config, threshold: float | None = None) -> DataFrame:
    """Contract objects, confirmed groups before fuzzy clusters."""
    t = settings.thresholds.duplicate if threshold is None else threshold
    found, members = dupes(store, settings, t)
    sure = identity.confirmed(items_of(store, settings), store.read("diffs"), settings.include_bots, settings.bot_logins)
    groups = export.identity_clusters(sure)
    first = export.contract_clusters(groups, sure, t, kind="identity")
    return first.unionByName(export.contract_clusters(found, members, t, first_index=groups.count())).orderBy("index")


def scan_repo(store: Store, settings: config.Config, repo: str, transport: str, provider: ingest.EmbeddingProvider) -> scanning.ScanReport:
    """Fetch a repository's open items, and closed ones where incident windows are declared, and bring the store up to date."""
    spark = store.spark
    spark.dataSource.register(ItemPages)
    pages = None
    for options in scanning.fetch_plan(settings.windows):
        one = spark.read.format("item_pages").options(transport=transport, repo=repo, **options).load()
        pages = one if pages is None else pages.unionByName(one)
    return scanning.scan(store, repo, ingest.fetched_items(checkpointed(pages), repo), provider)


def triage_folder(
    store: Store, settings: config.Config, folder: str, checkpoint: str, provider: ingest.EmbeddingProvider, auto_close: float | None = None,
    owners_file: str | None = None, limits: dict[str, config.RepoSettings] | None = None,
) -> DataFrame:
    """Drain a folder of events: items are matched with what was there before and stored, and what is to be done about them waits in the store.

    Intents are unique by (event, action), so a batch that is handled again after a failure tells nothing twice. ``owners_file``
    holds ownership rules. All intents are returned; ``export.deliver`` hands them on through the gate.
    """
    space = ingest.embedding_space(provider.name, provider.name, provider.dims)
    store.guard(space, provider.dims)
    if store.meta("embedding_space") != space:
        store.set_metas({"embedding_space": space, "geometry": GEOMETRY})

    def load():
        return items_of(store, settings).select("item_id", "type", "number", "created_at", "author", "author_is_bot"), store.read("embeddings").select("item_id", "embedding")

    def keep(new: DataFrame, batch: int) -> None:
        store.upsert("items", new)
        store.upsert("embeddings", new.select("item_id", "embedding").withColumn("embedding_space", F.lit(space)))

    def emit(matches: DataFrame, new: DataFrame, batch: int) -> None:
        matches = checkpointed(matches)
        if not matches.isEmpty():
            owners = routing.suggest_owners(new, owners_file) if owners_file else None
            store.upsert("intents", export.triage_intents(matches, new, store.read("items"), owners))

    t = settings.thresholds.duplicate
    stream = triage.triage_stream(
        triage.read_events(store.spark, folder), provider, load, keep, emit, checkpoint, threshold=t, auto_close=auto_close, bot_logins=settings.bot_logins, limits=limits
    )
    stream.awaitTermination()
    return store.read("intents")


def benchmark(store: Store, settings: config.Config, dims: int, threshold: float) -> dict:
    """How clusters on the first ``dims`` dimensions differ from those on all, with the membership of both."""
    items, full = items_of(store, settings), store.read("embeddings").select("item_id", "embedding")
    sides, heads, seconds = [], [], []
    for vectors in (full, full.withColumn("embedding", truncate(F.col("embedding"), dims))):
        began = time.perf_counter()
        found, members = clusters.find_clusters(items, vectors, threshold, settings.include_bots, settings.bot_logins)
        members = checkpointed(members)
        sides.append(members.select(F.col("cluster_id").alias("id"), F.col("item_id").alias("item")))
        heads.append(found.join(decide(members), "cluster_id").select(F.col("cluster_id").alias("id"), "size", "theme", "canonical"))
        seconds.append(round(time.perf_counter() - began, 3))
    out = stats.dimension_study(*sides, *heads)
    matches = checkpointed(stats.greedy_matches(stats.cluster_pairs(*sides)))
    out["matches"] = [r.asDict() for r in matches.orderBy("id_a").collect()]
    out["unmatched"] = [stats.unmatched(s, matches, side) for s, side in zip(sides, ("id_a", "id_b"), strict=True)]
    out["seconds"] = seconds
    return out


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tidewheel")
    p.add_argument("--store", required=True)
    p.add_argument("--config", help="YAML settings")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dupes", "export", "checklist", "digest"):
        sub.add_parser(name).add_argument("--threshold", type=float)
    told = sub.add_parser("report")
    told.add_argument("--threshold", type=float)
    told.add_argument("--vision", help="a document to compare items with")
    told.add_argument("--json", action="store_true")
    scan = sub.add_parser("scan")
    scan.add_argument("--transport", required=True)
    scan.add_argument("--repo", action="append", required=True)
    scan.add_argument("--report", action="store_true", help="print the backlog report")
    labels = sub.add_parser("labels")
    labels.add_argument("--threshold", type=float)
    labels.add_argument("--vision", help="a document to compare items with")
    events = sub.add_parser("triage")
    events.add_argument("events")
    events.add_argument("--checkpoint", required=True)
    events.add_argument("--auto-close", type=float, help="similarity from which a new item is to be closed; not at all if left out")
    events.add_argument("--owners", help="a file of ownership rules")
    events.add_argument("--repo-settings", action="append", default=[], metavar="REPO=FILE", help="JSON settings of a repository")
    judge = sub.add_parser("review")
    judge.add_argument("--provider", required=True, help="module:function that gives a provider")
    judge.add_argument("--type", choices=("pr", "issue"))
    judge.add_argument("--top", type=int)
    study = sub.add_parser("benchmark")
    study.add_argument("--dims", type=int, required=True)
    study.add_argument("--threshold", type=float)
    sub.add_parser("reset").add_argument("--yes", action="store_true")
    of = sub.add_parser("cluster")
    of.add_argument("item", help="id of an item, or a cluster's number")
    of.add_argument("--threshold", type=float)
    sub.add_parser("rank").add_argument("--top", type=int, default=20)
    sub.add_parser("vision").add_argument("document")
    pair = sub.add_parser("compare")
    pair.add_argument("first")
    pair.add_argument("second")
    for name in ("stats", "reembed", "doctor"):
        sub.add_parser(name)
    a = p.parse_args(args)
    store = Store(_session(), a.store)
    settings = config.load(open(a.config).read()) if a.config else config.Config()

    def show(df: DataFrame) -> None:
        for row in export.line_json(df).toLocalIterator():
            print(row["value"])

    if a.command == "dupes":
        found, _ = dupes(store, settings, a.threshold)
        show(found.withColumn("theme", clean_title(F.col("theme"))).orderBy("cluster_id"))
    elif a.command == "export":
        for row in contract(store, settings, a.threshold).toLocalIterator():
            print(row["json"])
    elif a.command == "checklist":
        found, members = dupes(store, settings, a.threshold)
        sure = identity.confirmed(items_of(store, settings), store.read("diffs"), settings.include_bots, settings.bot_logins)
        print(export.checklist(found, members, ", ".join(settings.repos) or "all repositories", sure))
    elif a.command == "digest":
        found, members = dupes(store, settings, a.threshold)
        print(digest.weekly_digest(items_of(store, settings), found, members, week_start(F.current_timestamp())))
    elif a.command == "report":
        found, _ = dupes(store, settings, a.threshold)
        ranked = rank(store, settings, datetime.now(timezone.utc))
        fit = alignment(store, settings, a.vision, ingest.HashingEmbedder()) if a.vision else None
        totals = {"items": items_of(store, settings).count(), "clusters": found.count()}
        print((export.report_json if a.json else export.report)(found, ranked, totals, fit))
    elif a.command == "scan":
        reports = [scan_repo(store, settings, repo, a.transport, ingest.HashingEmbedder()) for repo in a.repo]
        if a.report:
            print(digest.backlog_report(reports, *dupes(store, settings)))
        else:
            for line in (x for r in reports for x in r.lines()):
                print(line)
    elif a.command == "labels":
        _, members = dupes(store, settings, a.threshold)
        members = checkpointed(members)
        fit = alignment(store, settings, a.vision, ingest.HashingEmbedder()) if a.vision else None
        show(export.label_actions(decide(members), members, fit).orderBy("item_id", "label"))
    elif a.command == "triage":
        limits = {repo: config.repo_settings(open(file).read()) for repo, _, file in (x.partition("=") for x in a.repo_settings)}
        rules = open(a.owners).read() if a.owners else None
        show(triage_folder(store, settings, a.events, a.checkpoint, ingest.HashingEmbedder(), a.auto_close, rules, limits).orderBy("event_id", "action"))
    elif a.command == "review":
        module, _, function = a.provider.partition(":")
        provider = getattr(importlib.import_module(module), function)()
        wanted = ingest.cached_diffs(items_of(store, settings), store.read("diffs"))
        got = checkpointed(reviews.review(wanted, provider, a.type, a.top))
        known = items_of(store, settings).select("item_id", "repo", "number", "type")
        good = got.filter("error is null").join(known, "item_id")
        store.upsert("reviews", good.select("number", "repo", "type", F.lit(provider.name).alias("provider"), F.lit(provider.model).alias("model"), "summary", "concerns", "recommendation", "confidence", F.current_timestamp().alias("reviewed_at")))
        show(got.orderBy("item_id"))
    elif a.command == "benchmark":
        print(json.dumps(benchmark(store, settings, a.dims, settings.thresholds.duplicate if a.threshold is None else a.threshold)))
    elif a.command == "reset":
        if not a.yes:
            p.error("reset forgets everything; say --yes")
        store.reset()
    elif a.command == "cluster":
        _, members = dupes(store, settings, a.threshold)
        wanted = members.filter(F.col("item_id") == a.item).select("cluster_id") if ":" in a.item else members.filter(F.col("cluster_id") == int(a.item)).select("cluster_id").distinct()
        show(members.join(wanted, "cluster_id", "left_semi").select("cluster_id", "item_id", "score", clean_title(F.col("title")).alias("title")).orderBy("cluster_id", F.desc("score"), "item_id"))
    elif a.command == "rank":
        show(rank(store, settings, datetime.now(timezone.utc)).limit(a.top).select("item_id", "score", clean_title(F.col("title")).alias("title")))
    elif a.command == "vision":
        show(alignment(store, settings, a.document, ingest.HashingEmbedder()))
    elif a.command == "compare":
        show(similarity.compare(store.read("embeddings"), a.first, a.second))
    elif a.command == "stats":
        show(stats.repo_stats(items_of(store, settings), store.read("diffs")))
    elif a.command == "doctor":
        store.guard()
        ingest.probe(ingest.HashingEmbedder())
        print("ok")
    else:
        store.reembed(ingest.HashingEmbedder())
    return 0


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
