"""The scan job from paged records to the store, what a crash leaves behind, digests, reports and commands."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import tidewheel
from tidewheel.__main__ import benchmark, main, triage_folder
from tidewheel.operators import clusters, identity
from tidewheel.plans import digest, export
from tidewheel.sources import config, ingest, scan
from tidewheel.sources.store import Store
from tidewheel.streaming import webhook

CALLS = {"wave": 1}


def fetch(repo, kind, state, cursor, size):
    """Two waves of records: the second has one more, one updated, one with another label."""
    if state == "closed":
        return [], None
    late = CALLS["wave"] == 2
    rows = []
    for n in range(1, 7 if late else 6):
        if (n % 2 == 0) != (kind == "issue"):
            continue
        rows.append({
            "number": n, "title": "crash on start" if n < 4 else f"topic {n}", "body": f"text {n % 3}", "state": "OPEN", "createdAt": datetime(2024, 1, n),
            "updatedAt": datetime(2024, 2, n) if late and n == 1 else datetime(2024, 1, n), "updated_at": datetime(2024, 1, n), "author": {"login": "ann", "typename": "User"},
            "labels": ["bug"] if late and n == 3 else [], "nodeId": f"N{n}", "headRefOid": "h" if n in (1, 3) else f"h{n}", "files": ["a_test.py"], "changedFiles": 1,
            "closing": [{"number": 2, "repo": repo}] if n == 1 else [],
        })
    return rows, None


@pytest.fixture
def path(tmp_path):
    CALLS["wave"] = 1
    return f"file://{tmp_path}/s"


def scanned(path, capsys):
    main(["--store", path, "scan", "--transport", "tests.test_scan:fetch", "--repo", "o/r"])
    return capsys.readouterr().out


def test_scan_command_brings_a_store_up_to_date(spark, path, capsys):
    assert "5 fetched, 5 new, 0 updated, 0 unchanged, 0 with new metadata, 5 embedded" in scanned(path, capsys)
    store = Store(spark, path)
    r = store.by_number("o/r", 1).first()
    assert (r["type"], r["state"], r["has_tests"], r["closes_issues"], r["node_id"], r["full_body"]) == ("pr", "open", True, [2], "N1", "text 1")
    assert store.by_number("o/r", 2, "pr").isEmpty() and store.item("o/r:issue:2").count() == 1 and store.vector("o/r:pr:1").count() == 1
    assert "5 unchanged" in scanned(path, capsys)
    pages = spark.createDataFrame([(k, json.dumps(row, default=str)) for k in ("pr", "issue") for row in second(k)], "kind string, record string")
    report = scan.scan(store, "o/r", ingest.fetched_items(pages, "o/r"), ingest.HashingEmbedder())
    assert (report.new, report.updated, report.unchanged, report.refreshed, report.embedded) == (1, 1, 4, 1, 2)
    assert store.by_number("o/r", 3).first()["labels"] == ["bug"] and store.read("items").count() == store.read("embeddings").count() == 6
    with pytest.raises(ValueError, match="re-embed"):
        scan.scan(store, "o/r", ingest.fetched_items(pages, "o/r"), ingest.HashingEmbedder(8, "other"))
    one = ingest.one_item(pages.withColumn("number", F.get_json_object("record", "$.number").cast("long")), "o/r", 3)
    assert one.first()["item_id"] == "o/r:pr:3"


def second(kind):
    CALLS["wave"] = 2
    try:
        return fetch("o/r", kind, "open", None, 100)[0]
    finally:
        CALLS["wave"] = 1


def test_upsert_takes_the_latest_of_repeated_rows(spark, path):
    store = Store(spark, path)
    ddl = "number long, repo string, patch_text string, fetched_at timestamp"
    rows = [(1, "o/r", "late", datetime(2024, 1, 2)), (1, "o/r", "early", datetime(2024, 1, 1)), (1, "o/s", "other", None)]
    store.upsert("diffs", spark.createDataFrame(rows, ddl))
    assert sorted((r["repo"], r["patch_text"]) for r in store.read("diffs").collect()) == [("o/r", "late"), ("o/s", "other")]
    got = ingest.fetched_diffs(spark.createDataFrame([("o/r", 1), ("o/r", 2)], "repo string, number long"), store.read("diffs"), lambda repo, n: f"diff {n} of {repo}", datetime(2024, 3, 1))
    store.upsert("diffs", got)
    assert store.read("diffs").filter("number = 2").first()["patch_text"] == "diff 2 of o/r" and store.read("diffs").count() == 3
    store.upsert("reviews", spark.createDataFrame([(1, "o/r", "pr", "p", "m", "s", [], "merge", 0.5, None)], store.read("reviews").schema))
    store.upsert("author_stats", spark.createDataFrame([("ann", "o/r", 3, datetime(2024, 1, 1)), ("ann", "o/r", 4, datetime(2024, 1, 2))], store.read("author_stats").schema))
    assert store.read("author_stats").first()["merge_count"] == 4 and store.read("reviews").count() == 1
    store.reset()
    assert store.read("diffs").isEmpty() and store.read("reviews").isEmpty()


def test_vectors_can_be_dropped_and_lengths_are_guarded(spark, path, capsys):
    scanned(path, capsys)
    store = Store(spark, path)
    with pytest.raises(ValueError, match="dimensions"):
        store.guard(dims=3)
    store.drop_vectors()
    assert not store.has_embeddings() and store.meta("embedding_space") is None and store.read("items").count() == 5
    store.guard("another space", 3)


def test_digest_report_checklist_and_commands(spark, path, capsys, tmp_path):
    scanned(path, capsys)
    store = Store(spark, path)
    items = store.read("items").withColumn("incident_closed", F.lit(False))
    found, members = clusters.find_clusters(items, store.read("embeddings").select("item_id", "embedding"), 0.5)
    text = digest.weekly_digest(items, found, members, F.lit("2024-01-04").cast("timestamp"))
    assert "2 new of 5 items in 1 repositories" in text and "1. crash on start: 3 items" in text
    report = scan.ScanReport("o/r", 5, 5, 0, 0, 0, 0, 5, 1)
    assert "warning: 1 items have no usable vector" in digest.backlog_report([report], found, members)
    assert [r["cluster_id"] for r in digest.clusters_of(members, "o/r", 1).collect()] == [1]
    assert digest.top_members(members, 2).filter("cluster_id = 1").first()["more"] == 1
    sure = identity.confirmed(items)
    told = export.checklist(found, members, "o/r", sure)
    assert "## Same change: crash on start" in told and "Keep o/r#1" in told and "- [ ] o/r#3 crash on start" in told
    main(["--store", path, "report", "--threshold", "0.5", "--json"])
    data = json.loads(capsys.readouterr().out)
    assert data["stats"]["items"] == 5 and data["clusters"][0]["size"] == 3 and len(data["best"]) == 5
    (tmp_path / "VISION.md").write_text("# Crash\n\ncrash on start is what we mend, at once and for all\n")
    main(["--store", path, "report", "--vision", f"file://{tmp_path}/VISION.md"])
    out = capsys.readouterr().out
    assert "## Vision" in out and "### Furthest from it" in out
    main(["--store", path, "cluster", "o/r:pr:1", "--threshold", "0.5"])
    assert len(capsys.readouterr().out.strip().split("\n")) == 3
    main(["--store", path, "checklist", "--threshold", "0.5"])
    main(["--store", path, "digest", "--threshold", "0.5"])
    assert "# Week in review" in capsys.readouterr().out
    study = benchmark(store, config.Config(), 32, 0.5)
    assert study["clusters"][0] == found.count() and len(study["matches"]) + study["unmatched"][0] == study["clusters"][0]
    with pytest.raises(SystemExit):
        main(["--store", path, "reset"])
    main(["--store", path, "reset", "--yes"])
    assert store.read("items").isEmpty()


class Provider:
    name, model = "fake", "one"

    def complete_json(self, prompt):
        return json.dumps({"summary": prompt[:9], "concerns": [], "recommendation": "merge", "confidence": 0.5})

    complete = complete_json


def test_triage_and_review_commands(spark, path, capsys, tmp_path):
    scanned(path, capsys)
    events = [{"event_id": 1, "action": "opened", "event_type": "issues", "number": 50, "title": "crash on start", "body": "text 1", "repo": {"full_name": "o/r"}, "sender": "a", "received_at": "2024-01-05T00:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(map(json.dumps, events)))
    told = triage_folder(Store(spark, path), config.Config(), str(tmp_path / "in"), str(tmp_path / "cp"), ingest.HashingEmbedder()).collect()
    assert [(r["item_id"], r["action"], r["target"]) for r in told] == [("o/r:issue:50", "comment", "o/r:pr:1")] and "#1" in told[0]["text"]
    assert Store(spark, path).item("o/r:issue:50").first()["state"] == "open" and Store(spark, path).vector("o/r:issue:50").count() == 1
    main(["--store", path, "review", "--provider", "tests.test_scan:Provider", "--type", "pr"])
    assert len(capsys.readouterr().out.strip().split("\n")) == 3 and Store(spark, path).read("reviews").count() == 3


def test_texts_of_comments():
    text = export.match_comment("o/r", [{"number": 7, "similarity": 0.912, "title": "a|b"}], {"number": 7}, 1.25, [("ann", "src/")])
    assert "91.2 %" in text and "a\\|b" in text and "@ann (src/)" in text and "[#7](https://github.com/o/r/issues/7)" in text
    assert "Closed in favour of [#3]" in export.close_comment("o/r", {"number": 3}, 0.97)


def test_settings_of_repositories_and_environment():
    s = config.repo_settings('{"cluster": {"bot_logins": ["x"]}, "auto_close": 0.9}')
    assert s.cluster.bot_logins == ["x"] and s.cluster.include_bots is False and s.auto_close == 0.9
    assert config.repo_settings(config.repo_settings_text(s)) == s and config.repo_settings(None).cluster is not config.repo_settings(None).cluster
    for bad in ('{"cluster": []}', '{"cluster": {"bot_logins": [""]}}', '{"incidents": {}}', '{"auto_close_enabled": 1}', '{"similarity": true}'):
        with pytest.raises(ValueError, match="must"):
            config.repo_settings(bad)
    assert config.environment("# c\nexport A='x y'\nB=2 # two\n\nC=\"q\"\nnone") == {"A": "x y", "B": "2", "C": "q"}


def test_installations_windows_endpoints_answers(spark):
    from tidewheel.functions.mapping import compile_windows
    from tidewheel.functions.text import endpoint_fingerprint

    body = json.dumps({"action": "created", "repositories": [{"full_name": "o/r"}, {}]}).encode()
    assert webhook.installed_repos(body, "installation") == ["o/r"] and webhook.installed_repos(body, "push") == []
    windows = compile_windows([{"start": " 2024-01-01T00:00:00+0200 ", "end": "2024-01-02T00:00:00Z", "reason": "x"}])
    assert windows[0].start == 1704060000000 and [p["state"] for p in scan.fetch_plan(windows)] == ["open", "closed"] and len(scan.fetch_plan([])) == 1
    urls = ["https://API.Example.com:443/v1/", "https://api.example.com/v1?x=1", "http://api.example.com:443/v1"]
    a, b, c = (r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(endpoint_fingerprint(F.col("u"))).collect())
    assert a == b != c
    assert ingest.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]) == [[1.0], [2.0]]
    with pytest.raises(ValueError, match="numbered"):
        ingest.in_order([{"index": 1, "embedding": [2.0]}])


def test_library_names():
    assert tidewheel.Store is Store and all(hasattr(tidewheel, n) for n in tidewheel.__all__)
    with pytest.raises(AttributeError):
        tidewheel.nothing  # noqa: B018


def test_a_slice_reads_its_own_items_only(spark, tmp_path):
    """What is pending is read twice, to be counted and to be dealt, however many slices there are."""
    store, seen = Store(spark, f"file://{tmp_path}/s"), spark.sparkContext.accumulator(0)

    def told(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(300).selectExpr("concat('o/r:pr:', id) AS item_id", "concat('t ', id) AS title", "'b' AS body")
    pending = rows.mapInPandas(told, rows.schema)
    assert scan.embed_slices(store, pending, ingest.HashingEmbedder(8), slice_items=50) == 0
    assert seen.value == 600 and store.read("embeddings").count() == 300
    want = {r["item_id"]: list(r["embedding"]) for r in ingest.embed(rows, ingest.HashingEmbedder(8)).collect()}
    assert {r["item_id"]: list(r["embedding"]) for r in store.read("embeddings").collect()} == want
    assert not list(tmp_path.glob("s/_pending*"))
