"""Author counts as keyed state: equal to the batch filter, expired by event time, kept over restarts."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import stats
from tidewheel.sources.store import Store
from tidewheel.streaming import authors

DDL = "repo string, author string, merge_count long, cached_at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, authors.STATE_PROVIDER)
    yield spark
    spark.conf.set(PROVIDER, before)


def row(author, count, day, hour=0, repo="o/r"):
    return {"repo": repo, "author": author, "merge_count": count, "cached_at": f"2024-01-{day:02d}T{hour:02d}:00:00Z"}


def test_counts_follow_merges_expire_and_survive_a_restart(rocks, tmp_path):
    spark, folder, told = rocks, tmp_path / "in", []
    folder.mkdir()

    def drain(name, rows):
        (folder / name).write_text("\n".join(map(json.dumps, rows)))
        found = authors.author_counts(spark.readStream.schema(DDL).json(str(folder)), "1 hour")
        query = found.writeStream.outputMode("update").foreachBatch(lambda b, _: told.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    first = [row("ann", 3, 1), row("bob", 5, 1, 6), row("ann", None, 1, 2), row("ann", None, 1, 1), row(None, 1, 1), row("cy", None, 1, 5)]
    drain("a.json", first)
    second = [row("ann", None, 1, 6), row("cy", 7, 1, 6), row("dan", 1, 2, 9)]  # the watermark is now past bob, ann and cy
    drain("b.json", second)
    third = [row("ann", None, 2, 10), row("bob", 6, 2, 10), row("dan", None, 2, 10)]
    drain("c.json", third)

    state: dict = {}
    for r in told:
        if r["live"]:
            state[r["author"]] = (r["merge_count"], r["cached_at"])
        else:
            assert state.pop(r["author"])[1] == r["cached_at"] and r["merge_count"] is None
    assert ("ann", 6) in {(r["author"], r["merge_count"]) for r in told if r["live"]}  # over a restart, in any order of times
    assert {a: c for a, (c, _) in state.items()} == {"bob": 6, "dan": 2}
    given = spark.createDataFrame([(r["repo"], r["author"], r["merge_count"], datetime.fromisoformat(r["cached_at"][:-1])) for r in first + second + third], DDL)
    seen = given.filter("merge_count is not null and author is not null")
    as_of = datetime(2024, 1, 2, 9)  # the watermark: an hour before the latest row
    batch = stats.fresh_authors(seen, as_of).groupBy("author").agg(F.max("cached_at").alias("cached_at"))
    assert {(r["author"], r["cached_at"]) for r in batch.collect()} == {(a, t) for a, (_, t) in state.items()}


def test_counts_reach_the_store(rocks, tmp_path):
    spark, store = rocks, Store(rocks, f"file://{tmp_path}/s")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, [row("ann", 3, 1), row("ann", None, 1, 3), row("ann", 9, 1, repo="o/s")])))
    authors.keep_authors(spark.readStream.schema(DDL).json(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert sorted((r["repo"], r["merge_count"]) for r in store.read("author_stats").collect()) == [("o/r", 4), ("o/s", 9)]
