"""Commands over a small store, errors, and the edge of the event stream."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.__main__ import contract, dupes, main, rank
from tidewheel.sources import config, errors, ingest
from tidewheel.sources.items import ITEM_DDL
from tidewheel.sources.store import Store
from tidewheel.streaming import webhook


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    columns = [c.strip().split()[0] for c in ITEM_DDL.split(", ")]
    rows = []
    for n, title in ((1, "crash on start"), (2, "crash on start"), (3, "dark mode")):
        known = {"item_id": f"o/r:pr:{n}", "type": "pr", "number": n, "repo": "o/r", "title": title, "body": "", "state": "open", "author": "ann", "created_at": datetime(2024, 1, n), "updated_at": datetime(2024, 1, n), "head_ref_oid": "h" if n < 3 else "x"}
        rows.append(tuple(known.get(c) for c in columns))
    store = Store(spark, path)
    store.upsert_items(spark.createDataFrame(rows, ITEM_DDL))
    store.reembed(ingest.HashingEmbedder())
    return path


def test_pipeline_over_a_store(spark, path):
    store, settings = Store(spark, path), config.Config()
    found, members = dupes(store, settings)
    assert found.first()["size"] == 2 and sorted(r["number"] for r in members.collect()) == [1, 2]
    objects = [json.loads(r["json"]) for r in contract(store, settings).collect()]
    assert [o["id"] for o in objects] == ["t085-identity-0", "t085-cluster-1"] and objects[0]["confirmed"] is True
    ranked = rank(store, settings, datetime(2024, 2, 1)).collect()
    assert [r["number"] for r in ranked] == [3, 2, 1]


def test_commands_print(spark, path, capsys):
    main(["--store", path, "stats"])
    main(["--store", path, "compare", "o/r:pr:1", "o/r:pr:2"])
    main(["--store", path, "doctor"])
    out = capsys.readouterr().out.strip().split("\n")
    assert json.loads(out[0])["items"] == 3 and json.loads(out[1])["verdict"] == "likely duplicates" and out[2] == "ok"
    main(["--store", path, "report"])
    assert "| crash on start |" in capsys.readouterr().out


def test_errors_and_signatures():
    assert errors.classify(401).status == 401 and "network" in str(errors.classify(None, "key s3cret", ("s3cret",)))
    assert "s3cret" not in str(errors.classify(None, "key s3cret", ("s3cret",)))
    body = json.dumps({"action": "opened", "issue": {"number": 1, "title": "t", "user": {"login": "a"}}, "repository": {"owner": {"login": "o"}, "name": "r", "full_name": "o/r"}}).encode()
    good = "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest()
    assert webhook.signature_ok(body, good, "k") and not webhook.signature_ok(body, good, "other") and not webhook.signature_ok(body, None, "k")
    assert webhook.event_row(body, "issues", 5)["number"] == 1 and webhook.event_row(body, "push", 5) is None


def test_weekly_windows_start_on_mondays(spark, tmp_path):
    from tidewheel.streaming.triage import weekly

    rows = spark.createDataFrame([(datetime(2024, 1, 7, 23), "a"), (datetime(2024, 1, 8, 1), "a")], "ts timestamp, event_type string")
    rows.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").json(f"{tmp_path}/in")
    q = weekly(stream).writeStream.outputMode("complete").format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["week"].day for r in spark.table("weeks").select("week").filter(F.col("n") == 1).collect()) == [1, 8]
