"""Merge counts of authors as keyed state that expires by event time.

A row of the input says at ``cached_at`` either how many merges an author has (``merge_count``), or, where that is null,
that one more was merged. State holds the latest count of a (repo, author) and the times of merges since, so the result
does not depend on the order in which rows come. It is dropped once the watermark is ``ttl_hours`` past the count.
The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewheel.sources.store import Store

OUTPUT_DDL = "repo string, author string, merge_count long, cached_at timestamp, live boolean"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AuthorCounts(StatefulProcessor):
    """The latest count of one author and later merges; a timer stands at the end of each one's life."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "merge_count long, at long")
        self.merges = handle.getListState("merges", "at long")

    def _told(self, key, count: int | None, at: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"repo": [key[0]], "author": [key[1]], "merge_count": pd.array([count], "Int64"), "cached_at": pd.to_datetime([at], unit="ms"), "live": [live]})

    def _keep(self, times: list[int]) -> None:
        if times:
            self.merges.put([(t,) for t in times])
        else:
            self.merges.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.count.get() if self.count.exists() else None
        best = (known[1], known[0]) if known else None
        times = [t for (t,) in self.merges.get()]
        for part in rows:
            for at, count in zip(part["at"].tolist(), part["merge_count"].tolist(), strict=True):
                self.handle.registerTimer(int(at) + self.ttl_ms)
                if pd.isna(count):
                    times.append(int(at))
                else:
                    best = max(best or (-1, -1), (int(at), int(count)))
        self._keep([t for t in times if best is None or t > best[0]])
        if best is not None:
            self.count.update((best[1], best[0]))
            yield self._told(key, best[1] + sum(t > best[0] for t in times), best[0], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms
        self._keep([t for (t,) in self.merges.get() if t > past])
        if self.count.exists():
            _, at = self.count.get()
            if at <= past:
                self.count.clear()
                yield self._told(key, None, at, False)

    def close(self) -> None:
        pass


def author_counts(rows: DataFrame, delay: str = "10 minutes", ttl_hours: int = 24) -> DataFrame:
    """A stream of ``(repo, author, merge_count, cached_at, live)`` from one of ``(repo, author, merge_count, cached_at)``.

    A key is told when its rows come, and once with ``live`` false and no count when it expires. Rows without a repository,
    author or time are left out; rows later than the watermark, which is ``delay`` behind the latest time, are dropped by Spark.
    """
    whole = rows.filter("repo is not null and author is not null and cached_at is not null").withWatermark("cached_at", delay)
    keyed = whole.select("repo", "author", F.col("merge_count").cast("double").alias("merge_count"), "cached_at", F.unix_millis("cached_at").alias("at"))
    return keyed.groupBy("repo", "author").transformWithStateInPandas(AuthorCounts(ttl_hours * 3_600_000), OUTPUT_DDL, "Update", "EventTime")


def keep_authors(rows: DataFrame, store: Store, checkpoint: str, delay: str = "10 minutes", ttl_hours: int = 24) -> StreamingQuery:
    """Bring the store's author counts up to date from what has arrived. A batch that is handled again writes the same rows.

    Expired keys are not deleted from the store, as readers of ``author_stats`` filter by time themselves.
    """
    kept = store.read("author_stats").schema

    def write(batch: DataFrame, _: int) -> None:
        live = batch.filter("live").select(*[F.col(f.name).cast(f.dataType) for f in kept])
        store.upsert("author_stats", live)

    stream = author_counts(rows, delay, ttl_hours).writeStream.outputMode("update")
    return stream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
