"""Merge on read: small writes, newest rows, first values, compaction, concurrent writers, and crashes between any two steps."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import store as st
from tidewheel.sources.items import ITEM_DDL
from tidewheel.sources.store import KEPT_VERSIONS, Store

DIFF = "number long, repo string, patch_text string, fetched_at timestamp"


def pairs(spark, **values):
    return spark.createDataFrame(list(values.items()), "key string, value string")


def held(store, name="meta"):
    return {r["key"]: r["value"] for r in store.read(name).collect()}


def parquet(folder):
    return {p: p.stat().st_size for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/s"


def test_one_row_into_a_million_writes_one_small_file(spark, path, tmp_path):
    store = Store(spark, path)
    text = F.sha2(F.col("id").cast("string"), 256)
    store.replace("diffs", spark.range(1_000_000).select(F.col("id").alias("number"), F.lit("o/r").alias("repo"), text.alias("patch_text"), F.lit(None).cast("timestamp").alias("fetched_at")))
    before = parquet(tmp_path / "s")
    assert len(store.manifest("diffs").base[0][1]) == 4 == store.manifest("diffs").buckets
    store.upsert("diffs", spark.createDataFrame([(77, "o/r", "new", datetime(2024, 1, 1))], DIFF))
    made = {p: n for p, n in parquet(tmp_path / "s").items() if p not in before}
    assert len(made) == 1 and sum(made.values()) < 3000 < sum(before.values()) / 1000 and before.keys() <= parquet(tmp_path / "s").keys()
    assert store.read("diffs").count() == 1_000_000 and store.read("diffs").filter("number = 77").first()["patch_text"] == "new"
    assert store.read("diffs", where={"repo": "o/r", "number": 77}).first()["patch_text"] == "new"
    plan = store.read("diffs")._jdf.queryExecution().toString()
    assert "NOT b#" in plan and "BroadcastHashJoin" in plan  # three buckets as they are, keys sent to the fourth
    store.compact("diffs")
    m = store.manifest("diffs")
    assert not m.deltas and [len(x[1]) for x in m.base] == [3, 1] and sum(x[2] for x in m.base) == 1_000_000
    assert store.read("diffs").count() == 1_000_000 and store.read("diffs").filter("number = 77").count() == 1


@pytest.mark.parametrize("seed", range(1))
def test_any_order_of_writes_reads_as_a_dictionary(spark, path, seed, monkeypatch):
    """Upserts, repeats within one, replacements and compactions against a dictionary; the first creation time stays."""
    monkeypatch.setattr(st, "BUCKET_ROWS", 5)
    monkeypatch.setattr(st, "MOST_DELTAS", 4)
    rng, store, want = random.Random(seed), Store(spark, path), {}
    columns = [c.strip().split()[0] for c in ITEM_DDL.split(", ")]

    def frame(rows):
        return spark.createDataFrame([tuple({"item_id": i, "title": t, "created_at": c, "updated_at": u}.get(x) for x in columns) for i, t, c, u in rows], ITEM_DDL)

    for step in range(7):
        rows = [(f"i{rng.randrange(25)}", f"t{step}-{k}", rng.choice([None, datetime(2024, 1, 1 + step)]), datetime(2024, 2, 1, step, k)) for k in range(rng.choice([1, 3, 12]))]
        if step and rng.random() < 0.2:
            store.compact("items")
        store.upsert("items", frame(rows))
        latest = {}
        for i, t, c, u in sorted(rows, key=lambda r: r[3]):
            latest[i] = (t, c)
        for i, (t, c) in latest.items():
            want[i] = (t, want.get(i, (None, None))[1] or c)
        got = {r["item_id"]: (r["title"], r["created_at"]) for r in store.read("items").collect()}
        assert got == want and store.read("items").count() == len(want)
        some = rng.choice(sorted(want))
        assert store.item(some).first()["title"] == want[some][0] and store.item("none").isEmpty()
    assert len(store.manifest("items").deltas) < 4 and len(store.versions("items")) == KEPT_VERSIONS


class Crash(Exception):
    pass


@pytest.mark.parametrize(("act", "step"), [("upsert", "write"), ("upsert", "create"), ("upsert", "rename"), ("upsert", "forget"), ("replace", "create"), ("replace", "forget"), ("compact", "write"), ("compact", "forget")])
def test_a_crash_between_steps_leaves_a_readable_version(spark, path, step, act):
    store = Store(spark, path)
    store.replace("meta", pairs(spark, a="1", b="1"))
    store.upsert("meta", pairs(spark, a="2"))
    before = held(store)

    class Dying(Store):
        def _write(self, *a):
            out = super()._write(*a)
            if step == "write":
                raise Crash
            return out

        def _commit(self, name, made):
            if step == "create":
                self._fs.create(self._path(f"{self.path}/_{name}-left"), True).close()
                raise Crash
            out = super()._commit(name, made)
            if step == "rename":
                raise Crash
            return out

        def _forget(self, name):
            if step == "forget":
                raise Crash
            super()._forget(name)

    with pytest.raises(Crash):
        dying = Dying(spark, path)
        {"upsert": lambda: dying.upsert("meta", pairs(spark, b="3")), "replace": lambda: dying.replace("meta", pairs(spark, c="3")), "compact": lambda: dying.compact("meta")}[act]()
    after = {"upsert": before | {"b": "3"}, "replace": {"c": "3"}, "compact": before}[act]
    assert held(store) == (before if step in ("write", "create") else after)
    store.upsert("meta", pairs(spark, z="9"))
    assert store.meta("z") == "9" and len(held(store)) == len(before if step in ("write", "create") else after) + 1


def test_writers_at_once(spark, path):
    """An upsert between another's reading and naming is listed before it; a replacement so overtaken is refused."""
    store = Store(spark, path)
    store.upsert("meta", pairs(spark, a="1"))

    class Overtaken(Store):
        left = 1

        def _commit(self, name, made):
            if self.left:
                self.left = 0
                Store(self.spark, self.path).upsert("meta", pairs(self.spark, a="early", b="early"))
            return super()._commit(name, made)

    Overtaken(spark, path).upsert("meta", pairs(spark, a="late"))
    assert held(store) == {"a": "late", "b": "early"}
    Overtaken(spark, path).compact("meta")
    assert held(store) == {"a": "early", "b": "early"} and len(store.manifest("meta").deltas) == 1
    with pytest.raises(RuntimeError, match="meanwhile"):
        Overtaken(spark, path).replace("meta", pairs(spark, c="x"))
    assert held(store) == {"a": "early", "b": "early"}


def test_old_versions_stay_for_their_readers(spark, path, tmp_path):
    store = Store(spark, path)
    store.replace("meta", pairs(spark, a="0"))
    plan, number = store.read("meta"), store.versions("meta")[-1]
    for k in range(1, KEPT_VERSIONS):
        store.replace("meta", pairs(spark, a=str(k)))
    assert plan.first()["value"] == store.read("meta", number).first()["value"] == "0" and store.meta("a") == str(KEPT_VERSIONS - 1)
    folders = len(list((tmp_path / "s").glob("meta-*")))
    store.replace("meta", pairs(spark, a="9"))
    assert len(list((tmp_path / "s").glob("meta-*"))) == folders and len(store.versions("meta")) == KEPT_VERSIONS


def test_empty_writes(spark, path):
    store = Store(spark, path)
    assert store.read("meta").isEmpty() and store.meta("a") is None
    store.upsert("meta", pairs(spark, a="1").limit(0))
    assert store.read("meta").isEmpty()
    store.upsert("meta", pairs(spark, a="1"))
    store.replace("meta", pairs(spark, a="1").limit(0))
    assert store.read("meta").isEmpty() and store.meta("a") is None
    store.upsert("meta", pairs(spark, a="2"))
    store.compact("meta")
    assert held(store) == {"a": "2"}


class Counting:
    """A provider that notes each call in a folder, and dies after so many of them."""

    name, dims = "counting", 4

    def __init__(self, folder, most=None):
        self.folder, self.most = folder, most

    def embed_batch(self, texts):
        import os
        import uuid

        if self.most is not None and len(os.listdir(self.folder)) >= self.most:
            os._exit(1)
        Path(self.folder, uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]


def asked(folder):
    return [t for p in Path(folder).iterdir() for t in p.read_text().split("\n")]


def test_a_dying_provider_leaves_its_slices(spark, path, tmp_path):
    """After k slices k are kept, and the next scan embeds only the rest; so does re-embedding that stops between."""
    from tidewheel.sources import scan
    from tidewheel.sources.ingest import HashingEmbedder
    from tidewheel.sources.items import with_columns

    calls = tmp_path / "calls"
    calls.mkdir()
    n = F.col("id")
    fetched = with_columns(spark.range(40).select(F.format_string("o/r:pr:%d", n).alias("item_id"), F.lit("pr").alias("type"), n.alias("number"), F.lit("o/r").alias("repo"), F.format_string("title %d", n).alias("title"), F.lit("2024-01-01").cast("timestamp").alias("updated_at")), ITEM_DDL)
    fetched = fetched.coalesce(1)
    store = Store(spark, path)

    class Dying(Store):
        left = 2

        def upsert(self, name, incoming):
            if name == "embeddings":
                if not self.left:
                    raise Crash
                self.left -= 1
            super().upsert(name, incoming)

    with pytest.raises(Crash):
        scan.scan(Dying(spark, path), "o/r", fetched, Counting(str(calls)), slice_items=10)
    kept = store.read("embeddings").count()
    first = len(asked(calls))
    assert 0 < kept < 40 and kept <= first < 40 and store.read("items").count() == 40
    report = scan.scan(store, "o/r", fetched, Counting(str(calls)), slice_items=10)
    assert report.missing_vector == report.embedded == 40 - kept and store.read("embeddings").count() == 40
    assert len(asked(calls)) == first + 40 - kept
    # an item whose new text was stored, its vector not, misses its vector though its time is known
    changed = fetched.withColumn("title", F.when(F.col("number") == 7, "another").otherwise(F.col("title"))).withColumn("updated_at", F.when(F.col("number") == 7, F.lit("2024-02-01").cast("timestamp")).otherwise(F.col("updated_at")))
    store.upsert("items", changed.filter("number = 7"))
    assert scan.scan(store, "o/r", changed, Counting(str(calls))).missing_vector == 1
    assert scan.scan(store, "o/r", changed, Counting(str(calls))).unchanged == 40
    dying = Dying(spark, path)
    with pytest.raises(Crash):
        scan.reembed(dying, HashingEmbedder(8), slice_items=10)
    with pytest.raises(ValueError, match="re-embed"):
        store.guard("counting:counting:4:t2")
    done = store.read("embeddings").filter("embedding_space like 'hashing%'").count()
    seen = []
    real = scan.ingest.embed
    scan.ingest.embed = lambda items, *a, **k: seen.append(items.count()) or real(items, *a, **k)
    try:
        scan.reembed(store, HashingEmbedder(8), slice_items=10)
    finally:
        scan.ingest.embed = real
    assert done > 0 and sum(seen) == 40 - done and store.read("embeddings").filter("size(embedding) = 8").count() == 40
    store.guard("hashing:hashing:8:t2", 8)
