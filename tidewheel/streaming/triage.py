"""Events as streams: which are triaged, matching of new items in micro-batches, weekly counts.

A durable source and its checkpoint replace a queue in memory: what arrives during a batch waits there and
survives a restart. Run with ``trigger(availableNow=True)`` to drain a backlog before going on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.functions.mapping import cluster_key, is_bot
from tidewheel.functions.vectors import is_zero
from tidewheel.operators.similarity import cross_pairs
from tidewheel.sources.config import RepoSettings
from tidewheel.sources.ingest import EmbeddingProvider, embed

EVENT_DDL = (
    "event_id bigint, action string, event_type string, number bigint, title string, body string,"
    " repo struct<owner:string,name:string,full_name:string>, sender string, received_at timestamp"
)
MATCH_DDL = "item_id string, event_id bigint, match string, sim double, rank int, canonical boolean, auto_close boolean"


def read_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Events from a folder of JSON files; a micro-batch takes at most ``files`` of them, a backlog too."""
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", files).json(path)


def opened(events: DataFrame) -> DataFrame:
    """Items of ``opened`` issue and pull request events."""
    kind = F.when(F.col("event_type") == "pull_request", "pr").otherwise("issue")
    kept = events.filter((F.col("action") == "opened") & F.col("event_type").isin("issues", "pull_request"))
    return kept.select(
        "event_id", cluster_key(F.col("repo.full_name"), kind, F.col("number")).alias("item_id"), kind.alias("type"), "number",
        F.col("repo.full_name").alias("repo"), "title", F.coalesce("body", F.lit("")).alias("body"), F.col("sender").alias("author"),
        F.lit(None).cast("boolean").alias("author_is_bot"), F.lit("open").alias("state"), F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"),
    )


def _by_repo(limits: dict[str, RepoSettings], pick: Callable[[RepoSettings], float | None], default: float | None) -> Column:
    """A setting of the item's repository as a column; repositories without settings have the default."""
    out = F.lit(default).cast("double")
    for repo, own in limits.items():
        out = F.when(F.col("repo") == repo, F.lit(pick(own)).cast("double")).otherwise(out)
    return out


def match_batch(
    new: DataFrame, vectors: DataFrame, known: DataFrame, threshold: float = 0.85, auto_close: float | None = None, bot_logins: tuple[str, ...] = (), limits: dict[str, RepoSettings] | None = None
) -> DataFrame:
    """Matches of a batch's items with stored ones and with earlier items of the batch.

    ``limits``: settings of repositories, whose thresholds stand for the general ones in their own items.

    ``new``: item columns, event_id and embedding. ``known``: item_id, type, number, created_at, author and
    author_is_bot of stored items. Bots neither ask nor answer, nor do zero vectors. The canonical match is
    decided in the incoming item's mode with similarity as score.
    """
    people = new.filter(~is_bot(F.col("author"), F.col("author_is_bot"), bot_logins) & ~is_zero(F.col("embedding")))
    limits = limits or {}
    asked = people.select("item_id", "event_id", "repo", F.col("type").alias("mode"))
    stored = (
        known.filter(~is_bot(F.col("author"), F.col("author_is_bot"), bot_logins))
        .join(vectors.filter(~is_zero(F.col("embedding"))), "item_id")
        .join(new.select("item_id"), "item_id", "left_anti")
        .select(F.lit(-1).cast("bigint").alias("seen"), F.col("item_id").alias("match"), "number", "created_at", "embedding")
    )
    fresh = people.select(F.col("event_id").alias("seen"), F.col("item_id").alias("match"), "number", "created_at", "embedding")
    held = stored.unionByName(fresh)
    near = cross_pairs(people.select("item_id", "embedding"), held.select(F.col("match").alias("item_id"), "embedding"), min([threshold, *(x.similarity for x in limits.values())])).filter("match <> item_id")
    enough = F.col("sim") >= _by_repo(limits, lambda x: x.similarity, threshold)
    hits = near.join(asked, "item_id").join(held.drop("embedding"), "match").filter(F.col("seen") < F.col("event_id")).filter(enough)
    by_sim = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("sim"), "match"))
    early = F.row_number().over(Window.partitionBy("item_id").orderBy(F.asc_nulls_last("created_at"), F.desc("sim"), "number", "match"))
    first = F.when(F.col("mode") == "issue", early).otherwise(by_sim) == 1
    close = F.coalesce((F.col("sim") >= _by_repo(limits, lambda x: x.auto_close if x.auto_close_enabled else None, auto_close)) & (by_sim == 1), F.lit(False))
    return hits.select("item_id", "event_id", "match", "sim", by_sim.cast("int").alias("rank"), first.alias("canonical"), close.alias("auto_close"))


def triage_stream(
    events: DataFrame,
    provider: EmbeddingProvider,
    load: Callable[[], tuple[DataFrame, DataFrame]],
    store: Callable[[DataFrame, int], None],
    emit: Callable[[DataFrame, DataFrame, int], None],
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Embed, match, emit and store each micro-batch; ``store`` and ``emit`` get the batch id and must be idempotent.

    A batch that failed anywhere is handled again from its start: an item's own earlier self never counts among what it is
    matched with, so the matches are those of the first time, and a sink keyed by (event, action) holds each once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = opened(batch).dropDuplicates(["item_id"])
        made = embed(new, provider, text="body").select("item_id", "embedding")
        ready = new.join(made, "item_id").persist()
        try:
            known, vectors = load()
            emit(match_batch(ready, vectors, known, **options), ready, batch_id)
            store(ready, batch_id)
        finally:
            ready.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly(events: DataFrame, time: str = "ts", by: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts in Monday-to-Monday windows; the epoch is a Thursday, so weeks start four days on."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 week", "1 week", "4 days").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), by, "n")
