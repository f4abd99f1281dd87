"""Output forms: contract JSON, line JSON, markdown, checklists, label actions, and the write gate.

Everything up to the JSON column is a DataFrame; only the few rows a report shows are collected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.mapping import item_url
from tidewheel.functions.scoring import confidence
from tidewheel.functions.text import clean_title, percent, table_cell
from tidewheel.operators.canonical import closing_edges, decide, relations, tracker_roles
from tidewheel.operators.stats import vision_distribution, vision_sections
from tidewheel.plans.digest import off_vision

SCHEMA_VERSION = 1
#: Matches that a comment shows.
COMMENT_MATCHES = 10


def item_ref(prefix: str = "") -> Column:
    """Reference to an item; what is null is left out of the JSON, and so is a false incident mark."""
    c = lambda name: F.col(f"{prefix}{name}")
    return F.struct(
        c("repo").alias("repo"), c("number").alias("number"), c("type").alias("type"), item_url(c("repo"), c("type"), c("number")).alias("url"),
        F.when(c("node_id") != "", c("node_id")).alias("nodeId"), F.when(c("state").isin("open", "closed", "merged"), c("state")).alias("state"),
        F.when(c("incident_closed"), F.lit(True)).alias("incidentClosed"),
    )


def _complete(members: DataFrame) -> DataFrame:
    for name, kind in (("node_id", "string"), ("incident_closed", "boolean")):
        if name not in members.columns:
            members = members.withColumn(name, F.lit(None).cast(kind))
    return members


def contract_clusters(clusters: DataFrame, members: DataFrame, threshold: float, kind: str = "cluster", first_index: int = 0) -> DataFrame:
    """``(index, json)``: one contract object per cluster; ``kind`` identity decides by earliest report."""
    members = _complete(members)
    decisions = decide(members, "issue" if kind == "identity" else None)
    refs = members.select("cluster_id", "item_id", item_ref().alias("r"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    closes = F.when(F.col("type") == "pr", F.col("closes_issues"))
    item = F.struct(
        *[item_ref()[n].alias(n) for n in ("repo", "number", "type", "url", "nodeId", "state", "incidentClosed")], clean_title(F.col("title")).alias("title"),
        F.col("author"), stamp("created_at").alias("createdAt"), stamp("updated_at").alias("updatedAt"), F.col("score"), closes.alias("closes"),
    )
    ranked = members.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"), item.alias("x")))), lambda t: t["x"]).alias("items")
    )
    roles = tracker_roles(members)
    held = F.struct("position", *[F.col("r")[n].alias(n) for n in ("repo", "number", "type", "url", "nodeId", "state", "incidentClosed")], "role", "score")
    tracked = roles.select("cluster_id", "position", "role", "score", "needs_tracker", item_ref().alias("r")).groupBy("cluster_id").agg(
        F.any_value("needs_tracker").alias("needsTracker"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") != "tracker", held))), lambda t: t.dropFields("position")).alias("candidates"),
        F.max(F.when(F.col("role") == "tracker", F.col("r"))).alias("ref"),
    )
    edges = closing_edges(members).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pr", "issue"))).alias("closingEdges"))
    named = F.concat(F.lit(f"t{str(threshold).replace('.', '', 1)}-{kind}-"), F.col("cluster_id"))
    joined = (
        clusters.join(decisions.drop("mode"), "cluster_id")
        .join(refs.select("cluster_id", F.col("item_id").alias("canonical"), F.col("r").alias("c")), ["cluster_id", "canonical"])
        .join(refs.select("cluster_id", F.col("item_id").alias("runner_up"), F.col("r").alias("u")), ["cluster_id", "runner_up"], "left")
        .join(ranked, "cluster_id").join(tracked, "cluster_id").join(relations(members), "cluster_id").join(edges, "cluster_id", "left")
    )
    parts = F.struct(
        F.filter("items", lambda i: i["type"] == "issue").alias("issues"),
        F.filter("items", lambda i: i["type"] == "pr").alias("prs"),
    )
    body = F.struct(
        named.alias("id"), (F.col("cluster_id") - (0 if kind == "identity" else 1) + first_index).alias("index"), clean_title(F.col("theme")).alias("theme"),
        F.size("items").alias("size"), F.col("avg_similarity").alias("avgSimilarity"), F.col("min_similarity").alias("minSimilarity"),
        confidence(F.col("min_similarity")).alias("confidence"), F.col("c").alias("canonical"), F.col("contested"), F.col("u").alias("runnerUp"),
        F.col("margin").alias("runnerUpMargin"), parts.alias("partition"), F.struct("ref", "needsTracker", "candidates").alias("tracker"), F.col("items"),
        F.when(F.lit(kind == "identity"), F.lit(True)).alias("confirmed"), F.col("relation"),
        F.when(F.col("relation").isNotNull(), F.coalesce("closingEdges", F.array().cast("array<struct<pr:bigint,issue:bigint>>"))).alias("closingEdges"),
    )
    return joined.select(body["index"].alias("index"), F.to_json(body).alias("json"))


def identity_clusters(members: DataFrame) -> DataFrame:
    """Cluster rows of confirmed groups: similarity 1, theme of the canonical item."""
    decisions = decide(members, "issue")
    theme = members.select("cluster_id", F.col("item_id").alias("canonical"), F.col("title").alias("theme"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return decisions.select("cluster_id", "canonical").join(theme, ["cluster_id", "canonical"]).join(size, "cluster_id").select(
        "cluster_id", "size", "theme", F.lit(1.0).alias("avg_similarity"), F.lit(1.0).alias("min_similarity")
    )


def line_json(df: DataFrame) -> DataFrame:
    """``(value)``: each row as a JSON object, the form that line-oriented consumers read."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def read_line_json(lines: DataFrame, ddl: str) -> DataFrame:
    """Objects among lines of mixed output."""
    return lines.filter(F.trim("value").startswith("{")).select(F.from_json("value", ddl).alias("x")).select("x.*")


def markdown_table(df: DataFrame, columns: dict[str, Column], limit: int) -> str:
    """The first ``limit`` rows as a markdown table; cells are cut and escaped by Spark."""
    cells = df.limit(limit).select(*[table_cell(c.cast("string")).alias(n) for n, c in columns.items()]).collect()
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(x or "" for x in row) + " |" for row in cells)])


def report_data(clusters: DataFrame, ranked: DataFrame, stats: dict, vision: DataFrame | None = None, top_clusters: int = 25, top_ranked: int = 20, top_off: int = 20) -> dict:
    """What a triage report shows: totals, largest clusters, best items, how items sit with the vision."""
    listed = clusters.orderBy("cluster_id").limit(top_clusters).select("cluster_id", "size", "avg_similarity", "min_similarity", "confidence", clean_title(F.col("theme")).alias("theme"))
    best = ranked.orderBy(F.desc("score"), "item_id").limit(top_ranked).select("item_id", "score", clean_title(F.col("title")).alias("title"))
    out = {"stats": stats, "clusters": [r.asDict() for r in listed.collect()], "best": [r.asDict() for r in best.collect()]}
    if vision is not None:
        out["vision"] = {
            "distribution": [r.asDict() for r in vision_distribution(vision).orderBy("classification").collect()],
            "sections": [r.asDict() for r in vision_sections(vision).collect()],
            "off_vision": [r.asDict() for r in off_vision(vision, top_off).select("item_id", "score").collect()],
        }
    return out


def _table(columns: list[str], rows: list[dict]) -> list[str]:
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v if v is not None else "").replace("|", "\\|")
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)]


def report(clusters: DataFrame, ranked: DataFrame, stats: dict, vision: DataFrame | None = None, top_clusters: int = 25, top_ranked: int = 20) -> str:
    """The triage report as markdown."""
    data = report_data(clusters, ranked, stats, vision, top_clusters, top_ranked)
    lines = ["# Triage report", "", *(f"- {k}: {v}" for k, v in stats.items()), "", "## Clusters", ""]
    lines += [*_table(["cluster_id", "size", "avg_similarity", "confidence", "theme"], data["clusters"]), "", "## Best items", ""]
    lines += _table(["item_id", "score", "title"], data["best"])
    if vision is not None:
        lines += ["", "## Vision", "", *_table(["classification", "n", "percent"], data["vision"]["distribution"]), ""]
        lines += [*_table(["section", "aligned", "drifting", "off_vision", "total"], data["vision"]["sections"]), "", "### Furthest from it", ""]
        lines += _table(["item_id", "score"], data["vision"]["off_vision"])
    return "\n".join(lines) + "\n"


def report_json(clusters: DataFrame, ranked: DataFrame, stats: dict, vision: DataFrame | None = None) -> str:
    """The triage report as one JSON object."""
    return json.dumps({"version": SCHEMA_VERSION} | report_data(clusters, ranked, stats, vision), default=str)


def vision_table(scores: DataFrame, top: int = 50) -> str:
    """Items by how well they fit the vision, best first."""
    columns = {"item": F.col("item_id"), "score": percent(F.col("score")), "class": F.col("classification"), "section": F.col("section")}
    return markdown_table(scores.orderBy(F.desc("score"), "item_id"), columns, top)


def _shown(c: str = "") -> Column:
    """How lists name an item: its repository and number."""
    return F.concat(F.col(f"{c}repo"), F.lit("#"), F.col(f"{c}number").cast("string"))


def checklist(clusters: DataFrame, members: DataFrame, repo: str, confirmed: DataFrame | None = None) -> str:
    """An editable checklist: confirmed groups and what to keep of them, then each cluster's tracker and what closes against it.

    ``confirmed``: members of ``identity.confirmed``. Members of both are told under the confirmed group only.
    """
    out = [f"# Checklist for {repo}"]
    if confirmed is not None:
        out += _confirmed_lines(confirmed)
        members = members.join(confirmed.select("item_id"), "item_id", "left_anti")
    rows = tracker_roles(members).join(clusters.select("cluster_id", "theme", "confidence"), "cluster_id")
    shown = rows.select("cluster_id", "position", "role", "needs_tracker", _shown().alias("ref"), "confidence", clean_title(F.col("theme"), 80).alias("theme"), clean_title(F.col("title"), 80).alias("title"))
    last, unsure, keeper = None, False, None
    for r in shown.orderBy("cluster_id", "position").toLocalIterator():
        if r["cluster_id"] != last:
            last, unsure, keeper = r["cluster_id"], r["confidence"] == "loose", None
            out += ["", f"## Cluster {last}: {r['theme']}", f"Confidence: {r['confidence']}{' (look before closing)' if unsure else ''}"]
            if r["needs_tracker"]:
                out.append("No issue tracks this yet; open one and close these in its favour:")
        if r["role"] == "tracker":
            keeper = r["ref"]
            out.append(f"Tracked by {keeper}, {r['title']}. {'Same problem? If so, close' if unsure else 'Close'} in its favour:")
        else:
            out.append(f"- [ ] {r['ref']} [{r['role']}] {r['title']}")
    return "\n".join(out) + "\n"


def _confirmed_lines(confirmed: DataFrame) -> list[str]:
    """Groups of the same change, the kept one first."""
    chosen = decide(_complete(confirmed), "issue").select("cluster_id", "canonical")
    rows = confirmed.join(chosen, "cluster_id").select("cluster_id", "basis", (F.col("item_id") == F.col("canonical")).alias("kept"), _shown().alias("ref"), "item_id", clean_title(F.col("title"), 80).alias("title"))
    out, last = [], None
    for r in rows.orderBy("cluster_id", F.desc("kept"), "item_id").toLocalIterator():
        if r["cluster_id"] != last:
            last = r["cluster_id"]
            why = "one head commit" if r["basis"] == "head-oid" else "one diff"
            out += ["", f"## Same change: {r['title']}", f"Confirmed by {why}. Keep {r['ref']}; the others duplicate it:"]
        if not r["kept"]:
            out.append(f"- [ ] {r['ref']} {r['title']}")
    return out


def match_comment(repo: str, matches: list, source: dict, seconds: float | None = None, owners: list[tuple[str, str]] = (), total: int | None = None) -> str:
    """The comment on a new item that resembles others; without ``seconds`` it is the same whenever it is made.

    ``total``: how many it resembles, where ``matches`` are only the best of them.
    """
    link = lambda n: f"[#{n}](https://github.com/{repo}/issues/{n})"
    lines = ["### Seen before?", "", f"{len(matches) if total is None else total} known items look like this one; {link(source['number'])} is the one to follow.", ""]
    lines += _table(["item", "likeness", "title"], [{"item": link(m["number"]), "likeness": f"{100 * m['similarity']:.1f} %", "title": m["title"]} for m in matches])
    if owners:
        lines += ["", "Reviewers who own the paths it names: " + ", ".join(f"@{o} ({p})" for o, p in owners)]
    return "\n".join([*lines, *([] if seconds is None else ["", f"_Compared in {seconds:.1f} s._"])])


def close_comment(repo: str, source: dict, similarity: float) -> str:
    """The comment with which a new item is closed in favour of another."""
    n = source["number"]
    return f"Closed in favour of [#{n}](https://github.com/{repo}/issues/{n}), which it repeats ({100 * similarity:.1f} % alike). Reopen it if that is wrong."


def triage_actions(matches: DataFrame) -> DataFrame:
    """``(event_id, item_id, action, target, similarity)``: a comment for each matched item, and a closure where the best match allows it.

    ``matches`` as ``triage.match_batch`` gives them; nothing is written here, see ``deliver``.
    """
    columns = lambda action: ("event_id", "item_id", F.lit(action).alias("action"), F.col("match").alias("target"), F.col("sim").alias("similarity"))
    return matches.filter("canonical").select(*columns("comment")).unionByName(matches.filter("auto_close").select(*columns("close")))


def triage_intents(matches: DataFrame, new: DataFrame, known: DataFrame, owners: DataFrame | None = None, shown: int = COMMENT_MATCHES) -> DataFrame:
    """``triage_actions`` with the ``text`` of each comment: the best ``shown`` matches, and owners of the paths that the item names.

    ``new``: the batch's items; ``known``: (item_id, number, title) of what can be matched; ``owners``: as ``routing.suggest_owners`` gives them.
    """
    titles = known.select("item_id", "number", "title").unionByName(new.select("item_id", "number", "title")).dropDuplicates(["item_id"])
    named = titles.select(F.col("item_id").alias("match"), F.col("number").alias("match_number"), F.col("title").alias("match_title"))
    best = matches.filter(F.col("rank") <= shown).join(named, "match")
    row = F.struct("rank", F.col("match_number").alias("number"), F.col("sim").alias("similarity"), clean_title(F.col("match_title")).alias("title"))
    listed = best.groupBy("item_id").agg(F.sort_array(F.collect_list(row)).alias("shown"))
    counted = matches.groupBy("item_id").agg(F.count("*").alias("total"))
    target = named.select(F.col("match").alias("target"), F.col("match_number").alias("target_number"))
    whole = triage_actions(matches).join(new.select("item_id", "repo"), "item_id").join(target, "target").join(listed, "item_id", "left").join(counted, "item_id")
    empty = F.array().cast("array<struct<owner:string,pattern:string>>")
    if owners is None:
        whole = whole.withColumn("owners", empty)
    else:
        own = owners.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "owner", "pattern"))).alias("o"))
        pick = F.transform("o", lambda x: F.struct(x["owner"].alias("owner"), x["pattern"].alias("pattern")))
        whole = whole.join(own, "item_id", "left").withColumn("owners", F.coalesce(pick, empty)).drop("o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [
                close_comment(r.repo, {"number": r.target_number}, r.similarity) if r.action == "close"
                else match_comment(r.repo, [] if r.shown is None else list(r.shown), {"number": r.target_number}, None, [(o["owner"], o["pattern"]) for o in r.owners], r.total)
                for r in f.itertuples()
            ]
            yield f[["event_id", "action", "item_id", "target", "similarity"]].assign(text=texts)

    return whole.mapInPandas(run, "event_id bigint, action string, item_id string, target string, similarity double, text string")


def deliver(store, gate: WriteGate, post: Callable[[dict], object], batch: int = 100) -> int:
    """Hand intents that were not delivered to ``post`` through the gate, some at a time, each noted when done; how many were.

    An intent's key (event_id, action) goes along: one whose note was lost comes again with the same key. While the
    gate is shut they stay in the store and are journalled.
    """
    done = 0
    while rows := store.read("intents").filter("delivered_at is null").orderBy("event_id", "action").limit(batch).collect():
        if not gate.enabled:
            gate.journal += [(r["action"], r["item_id"]) for r in rows]
            break
        for r in rows:
            gate.guard(r["action"], r["item_id"], lambda r=r: post(r.asDict()))
        told = store.spark.createDataFrame([(r["event_id"], r["action"]) for r in rows], "event_id bigint, action string")
        store.upsert("intents", store.read("intents").join(F.broadcast(told), ["event_id", "action"]).withColumn("delivered_at", F.current_timestamp()))
        done += len(rows)
    return done


def label_actions(decisions: DataFrame, members: DataFrame, vision: DataFrame | None = None) -> DataFrame:
    """``(item_id, action, label, reason)``: what labels would change; nothing is applied here."""
    duplicate = members.join(decisions.select("cluster_id", "canonical"), "cluster_id").filter("item_id <> canonical").select(
        "item_id", F.lit("add").alias("action"), F.lit("duplicate").alias("label"), F.concat(F.lit("duplicate of "), F.col("canonical")).alias("reason")
    )
    top = decisions.select(F.col("canonical").alias("item_id"), F.lit("add").alias("action"), F.lit("canonical").alias("label"), F.lit("source of truth").alias("reason"))
    out = duplicate.unionByName(top)
    if vision is not None:
        out = out.unionByName(vision.select("item_id", F.lit("add").alias("action"), F.col("classification").alias("label"), F.concat(F.lit("section "), F.col("section")).alias("reason")))
    return out.distinct()


@dataclass
class WriteGate:
    """External writes happen only when enabled; otherwise they are journalled as intents."""

    enabled: bool = False
    journal: list[tuple[str, str]] = field(default_factory=list)

    def guard(self, kind: str, target: str, run: Callable[[], object]) -> object | None:
        if self.enabled:
            return run()
        self.journal.append((kind, target))
        return None

    def intents(self, spark) -> DataFrame:
        return spark.createDataFrame(self.journal, "kind string, target string")
