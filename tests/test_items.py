"""Canonical choice, relations, identity, mapping, text, ingest, store, export and streaming on literal inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_clusters import ITEM
from tidewheel.functions import mapping, scoring, text
from tidewheel.operators import canonical, identity, routing, stats, vision
from tidewheel.plans import export
from tidewheel.sources import config, ingest, reviews
from tidewheel.sources.store import Store
from tidewheel.streaming import triage

MEMBER = "cluster_id int, item_id string, type string, number long, repo string, title string, state string, author string, created_at timestamp, updated_at timestamp, ci_status string, review_count int, score double, closes_issues array<long>"


def member(n, kind="pr", state="open", created=None, ci=None, score=0.5, reviews_=0, closes=(), cluster=1):
    day = None if created is None else datetime(2024, 1, 1 + created)
    return (cluster, f"o/r:{kind}:{n}", kind, n, "o/r", f"t{n}", state, "ann", day, day, ci, reviews_, score, None if closes is None else list(closes))


def decide(spark, *rows, mode=None):
    r = canonical.decide(spark.createDataFrame(rows, MEMBER), mode).first()
    return r["mode"], r["canonical"], r["runner_up"], r["contested"]


def test_canonical_rules(spark):
    assert decide(spark, member(1, "issue", created=5), member(2, "issue", created=1), member(3, created=9))[:2] == ("issue", "o/r:issue:2")
    assert decide(spark, member(1, score=0.9), member(2, state="merged", score=0.1))[1] == "o/r:pr:2"
    assert decide(spark, member(1, score=0.9, ci="failure"), member(2, score=0.1, ci="success")) == ("pr", "o/r:pr:2", "o/r:pr:1", False)
    assert decide(spark, member(1, score=0.52), member(2, score=0.5))[3] is True
    assert decide(spark, member(1, "issue", created=None), member(2, "issue", created=3)) == ("issue", "o/r:issue:2", "o/r:issue:1", False)
    assert decide(spark, member(1, "issue", created=1), member(2, "issue", created=2))[3] is True
    assert decide(spark, member(4), mode="issue") == ("issue", "o/r:pr:4", None, False)


def test_tracker_and_relations(spark):
    df = spark.createDataFrame([member(1, "issue", created=3), member(2, "issue", created=1), member(3, score=0.2, closes=[2]), member(4, score=0.9)], MEMBER)
    got = [(r["number"], r["role"]) for r in canonical.tracker_roles(df).orderBy("position").collect()]
    assert got == [(2, "tracker"), (4, "fix"), (3, "fix"), (1, "duplicate")]
    assert canonical.relations(df).first()["relation"] == "pr-issue-linked"
    unknown = spark.createDataFrame([member(1, "issue"), member(3, closes=None)], MEMBER)
    assert canonical.relations(unknown).first()["relation"] is None
    assert canonical.relations(spark.createDataFrame([member(3), member(4)], MEMBER)).first()["relation"] == "prs-only"


def test_scores(spark):
    row = spark.range(1).select(
        *[scoring.description_quality(F.lit(n)).alias(f"d{n}") for n in (0, 10, 125, 600, 1000, 99999)],
        *[scoring.author_history(F.lit(n)).alias(f"a{n}") for n in (0, 5, 20, 1000)],
        *[scoring.confidence(F.lit(x)).alias(f"c{k}") for k, x in enumerate((0.9, 0.8, 0.79, float("nan")))],
    ).first()
    assert [round(row[f"d{n}"], 6) for n in (0, 10, 125, 600, 1000, 99999)] == [0, 0.1, 0.45, 0.75, 0.9, 1.0]
    assert [round(row[f"a{n}"], 6) for n in (0, 5, 20, 1000)] == [0.1, 0.4, 0.7, 1.0]
    assert [row[f"c{k}"] for k in range(4)] == ["high", "solid", "loose", "loose"]


def test_windows_and_durations():
    w = mapping.compile_windows([{"start": "2026-07-23T00:00:00Z", "end": "2026-07-24T00:00:00+00:00", "reason": "sweep"}])
    assert w[0].end - w[0].start == 86_400_000
    for bad in ({"start": "2026-07-23", "end": "2026-07-24T00:00:00Z"}, {"start": "2026-07-24T00:00:00Z", "end": "2026-07-23T00:00:00Z"}):
        with pytest.raises(ValueError, match="window 0"):
            mapping.compile_windows([bad])
    assert mapping.parse_duration("1m").days == 30
    with pytest.raises(ValueError, match="duration"):
        mapping.parse_duration("3y")


def test_bots_and_text(spark):
    df = spark.createDataFrame([("app/Dependabot", None), ("x[bot]", None), ("dependabot-fan", None), ("dependabot", False), ("me", True), (None, None)], "author string, author_is_bot boolean")
    assert [r[0] for r in df.select(mapping.is_bot(F.col("author"), F.col("author_is_bot"), ("ci-runner",))).collect()] == [True, True, False, False, True, False]
    row = spark.range(1).select(
        text.clean_title(F.lit(" a\n\x1b[31mb  c ")).alias("t"), text.table_cell(F.lit("a|b\\")).alias("c"), text.repo_parts(F.lit("git@github.com:o/r.git")).alias("r"),
        text.repo_parts(F.lit("o")).alias("n"), text.paths(F.lit("see src/a/b.ts, and `c.json` or d.py")).alias("p"),
        text.diff_fingerprint(F.lit("index 1\n@@ x\n")).alias("e"), text.first_json_object(F.lit('x {"a": {"b": 1}} {')).alias("j"), text.embedding_text(F.lit(""), F.lit(" b ")).alias("m"),
    ).first()
    assert (row["t"], row["c"], row["r"]["name"], row["n"], row["e"], row["j"]) == ("a [31mb c", "a\\|b", "r", None, None, '{"a": {"b": 1}}')
    assert row["p"] == ["src/a/b.ts", "c.json", "d.py"] and row["m"] == "Untitled\n\nb"


def test_identity_passes(spark):
    names = [c.split()[0] for c in ITEM.split(", ")] + ["head_ref_oid"]
    rows = [{"item_id": f"o/r:pr:{n}", "type": "pr", "number": n, "repo": "o/r", "title": "t", "body": "", "state": "open", "author": "dependabot" if n == 6 else "a", "head_ref_oid": h} for n, h in ((1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x"))]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ITEM + ", head_ref_oid string")
    diffs = spark.createDataFrame([(3, "o/r", "index 1\n+a"), (4, "o/r", "@@ 2\n+a"), (5, "o/r", "index 9\n"), (1, "o/r", "+a")], "number long, repo string, patch_text string")
    got = sorted((r["cluster_id"], r["basis"], r["number"]) for r in identity.confirmed(df, diffs).collect())
    assert got == [(0, "head-oid", 1), (0, "head-oid", 2), (1, "patch-id", 3), (1, "patch-id", 4)]


def test_routing_and_outline(spark):
    t = spark.createDataFrame([("i", "bug in src/api/x.py", "")], "item_id string, title string, body string")
    got = [(r["owner"], r["pattern"]) for r in routing.suggest_owners(t, "# c\nsrc/api/ @a @b\n*.py @c @d\nbad a\n").orderBy("rank").collect()]
    assert got == [("a", "src/api/"), ("b", "src/api/"), ("c", "*.py")]
    doc = spark.createDataFrame([("d", "intro text that is long enough\n## One\nshort\n### Two\nthis text is also long enough\n#### four stays in the text")], "doc string, text string")
    assert [r["heading"] for r in vision.sections(doc).orderBy("idx").collect()] == ["Document Overview", "Two"]
    assert [r["idx"] for r in vision.embedding_inputs(doc).orderBy("idx").collect()] == [-1, 0, 2]


def test_overlap_cases(spark):
    def side(*groups):
        return spark.createDataFrame([(k, i) for k, g in enumerate(groups) for i in g], "id int, item int")

    assert stats.overlap(side([1, 2, 3, 4]), side([2, 3, 4, 5])).first()[0] == 60
    assert stats.overlap(side([1, 2]), side([1, 2])).first()[0] == 100
    assert stats.overlap(side(), side()).first()[0] == 100 and stats.overlap(side([1]), side()).first()[0] == 0
    pairs = stats.cluster_pairs(side([1, 2, 3], [4, 5]), side([1, 2], [3, 4, 5]))
    assert sorted(tuple(r) for r in stats.greedy_matches(pairs).collect()) == [(0, 0, 67), (1, 1, 67)]


def test_ingest_and_store(spark, tmp_path):
    raw = spark.createDataFrame([(1, "t", None, "closed", datetime(2024, 1, 2), datetime(2024, 1, 2), ("u", "Bot"), datetime(2024, 1, 1), datetime(2024, 1, 3))], "number long, title string, body string, state string, merged_at timestamp, closed_at timestamp, user struct<login:string,type:string>, created_at timestamp, updated_at timestamp")
    item = ingest.rest_pull_requests(raw, "o/r")
    r = item.first()
    assert (r["item_id"], r["state"], r["author_is_bot"], r["ci_status"], r["closes_issues"], r["body_length"]) == ("o/r:pr:1", "merged", True, None, None, 0)
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert_items(item)
    store.upsert_items(item.withColumn("title", F.lit("new")).withColumn("created_at", F.lit("2030-01-01").cast("timestamp")))
    kept = store.read("items").first()
    assert kept["title"] == "new" and kept["created_at"].year == 2024 and store.repos() == ["o/r"]
    assert not store.has_embeddings()
    store.reembed(ingest.HashingEmbedder(8))
    store.guard(ingest.embedding_space("hashing", "hashing", 8))
    with pytest.raises(ValueError, match="re-embed"):
        store.guard("other")
    assert store.read("embeddings").count() == 1


class Flaky(ingest.HashingEmbedder):
    def embed_batch(self, texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise RuntimeError("no")
        return super().embed_batch(texts)


def test_embedding_falls_back_to_zero(spark):
    df = spark.createDataFrame([("a", "good", ""), ("b", "bad", "")], "item_id string, title string, body string")
    got = {r["item_id"]: any(r["embedding"]) for r in ingest.embed(df, Flaky(8)).collect()}
    assert got == {"a": True, "b": False}


def test_export_contract(spark):
    members = spark.createDataFrame([member(1, "issue", created=1), member(2, score=0.9, created=2, closes=[1]), member(3, score=0.1, created=3)], MEMBER)
    found = spark.createDataFrame([(1, 3, "a\ntheme", 0.9, 0.85)], "cluster_id int, size long, theme string, avg_similarity double, min_similarity double")
    row = export.contract_clusters(found, members, 0.85).first()
    c = json.loads(row["json"])
    assert (row["index"], c["id"], c["theme"], c["confidence"], c["relation"]) == (0, "t085-cluster-1", "a theme", "solid", "pr-issue-linked")
    assert [i["number"] for i in c["items"]] == [2, 1, 3] and c["tracker"]["ref"]["number"] == 1 and c["closingEdges"] == [{"pr": 2, "issue": 1}]
    assert "confirmed" not in c and "incidentClosed" not in c["items"][0] and "closes" not in [i for i in c["items"] if i["type"] == "issue"][0]
    gate = export.WriteGate()
    assert gate.guard("label", "o/r#1", lambda: 1) is None and gate.journal == [("label", "o/r#1")]
    listed = export.checklist(found.withColumn("confidence", F.lit("solid")), members, "o/r")
    assert "Tracked by o/r#1, t1. Close in its favour:" in listed and "- [ ] o/r#2 [fix] t2" in listed
    assert export.label_actions(canonical.decide(members), members).count() == 3


def test_settings_and_reviews():
    c = config.load("repos: [o/r]\nthresholds: {duplicate: 0.9}\nincident_windows:\n- {start: '2026-01-01T00:00:00Z', end: '2026-01-02T00:00:00Z'}\n")
    assert c.thresholds.duplicate == 0.9 and len(c.windows) == 1
    with pytest.raises(ValueError, match="unknown"):
        config.load("colour: red")
    assert config.repo_settings("{broken") == config.RepoSettings()
    with pytest.raises(ValueError, match="similarity"):
        config.repo_settings('{"similarity": 7}')
    for bad in ("ftp://x", "https://a:b@x", "https://x/?q=1"):
        with pytest.raises(ValueError, match="provider"):
            config.provider_url(bad)
    assert reviews.parsed('so: {"summary": "s", "concerns": [], "recommendation": "merge", "confidence": 0.5} ok')["confidence"] == 0.5
    assert reviews.parsed('{"summary": 1}') is None


def fetch_pages(repo, kind, state, cursor, size):
    at = cursor or 0
    rows = [{"number": n, "title": f"{kind}{n}", "body": "", "state": state, "author": "a", "updated_at": datetime(2024, 1, 30 - n), "created_at": datetime(2024, 1, 1)} for n in range(at, min(at + size, 7))]
    return rows, at + size if at + size < 7 else None


def test_paged_source(spark):
    from tidewheel.sources.api import ItemPages

    spark.dataSource.register(ItemPages)
    read = spark.read.format("item_pages").option("transport", "tests.test_items:fetch_pages").option("repo", "o/r").option("page_size", 2)
    assert read.load().count() == 14
    assert read.option("max_items", 3).option("kinds", "pr").load().count() == 4
    assert spark.read.format("item_pages").option("transport", "tests.test_items:fetch_pages").option("repo", "o/r").option("kinds", "pr").option("since", "2024-01-28T00:00:00").load().count() == 3


def test_triage_stream(spark, tmp_path):
    events = [
        {"event_id": 1, "action": "opened", "event_type": "issues", "number": 10, "title": "crash on start", "body": "", "repo": {"full_name": "o/r"}, "sender": "a", "received_at": "2024-01-05T00:00:00Z"},
        {"event_id": 2, "action": "opened", "event_type": "issues", "number": 11, "title": "crash on start", "body": "", "repo": {"full_name": "o/r"}, "sender": "b", "received_at": "2024-01-06T00:00:00Z"},
        {"event_id": 3, "action": "closed", "event_type": "issues", "number": 12, "title": "crash on start", "body": "", "repo": {"full_name": "o/r"}, "sender": "b", "received_at": "2024-01-06T00:00:00Z"},
        {"event_id": 4, "action": "opened", "event_type": "issues", "number": 13, "title": "crash on start", "body": "", "repo": {"full_name": "o/r"}, "sender": "x[bot]", "received_at": "2024-01-06T00:00:00Z"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(map(json.dumps, events)))
    known = spark.createDataFrame([("o/r:issue:1", "issue", 1, datetime(2024, 1, 1), "c", None)], "item_id string, type string, number long, created_at timestamp, author string, author_is_bot boolean")
    vec = ingest.embed(spark.createDataFrame([("o/r:issue:1", "crash on start", "")], "item_id string, title string, body string"), ingest.HashingEmbedder()).select("item_id", "embedding")
    out, stored = [], []
    q = triage.triage_stream(
        triage.read_events(spark, str(tmp_path / "in")), ingest.HashingEmbedder(), lambda: (known, vec),
        lambda df, b: stored.extend(df.collect()), lambda df, new, b: out.extend(df.collect()), str(tmp_path / "cp"), auto_close=0.95,
    )
    q.awaitTermination(120)
    assert sorted(r["number"] for r in stored) == [10, 11, 13]
    assert sorted((r["item_id"][-2:], r["match"], r["canonical"]) for r in out) == [("10", "o/r:issue:1", True), ("11", "o/r:issue:1", True), ("11", "o/r:issue:10", False)]
    assert sum(r["auto_close"] for r in out) == 2
