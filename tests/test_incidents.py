"""Incident windows as a table against the chain of windows, and ownership rules in one automaton against one pattern at a time."""

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewheel.functions import mapping, text
from tidewheel.operators import incidents, routing

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ITEMS = "item_id string, state string, closed_at timestamp, start string, level int"


def items(spark, moments):
    """Closed at the given milliseconds; columns with names of the window tables stay."""
    return spark.createDataFrame([(f"i{k}", "closed", T0 + timedelta(milliseconds=m), "s", 3) for k, m in enumerate(moments)], ITEMS)


def told(df):
    return {r["item_id"]: r["incident_closed"] for r in df.collect()}


def test_table_of_windows_equals_the_chain(spark):
    draw = random.Random(1)
    base = round(T0.timestamp() * 1000)
    for longest in (3, 40, 5000):
        spans = [(at, at + 1 + draw.randrange(longest)) for at in (draw.randrange(3000) for _ in range(60 if longest < 5000 else 4))]
        windows = [mapping.Window(base + a, base + b, "r") for a, b in spans]
        df = items(spark, [*range(0, 3000, 7), *(x for a, b in spans for x in (a - 1, a, b - 1, b))])
        want = told(df.withColumn("incident_closed", mapping.incident_closed(F.col("state"), F.col("closed_at"), windows)))
        made = incidents.mark_incidents(df, incidents.window_table(spark, windows))
        assert made.columns == [*df.columns, "incident_closed"] and told(made) == want and len(set(want.values())) == 2


def test_times_before_the_epoch_nulls_other_states_and_repeated_rows(spark):
    old = datetime(1969, 12, 31, 23, 0, tzinfo=timezone.utc)
    rows = [("a", "closed", old, None, 0), ("a", "closed", old, None, 0), ("b", "open", old, None, 0), ("c", "closed", None, None, 0), ("d", None, old, None, 0), ("e", "closed", old + timedelta(hours=1), None, 0)]
    df = spark.createDataFrame(rows, ITEMS)
    spans = spark.createDataFrame([(-3_600_000, 0, "x"), (5, 5, "empty"), (9, 1, "turned"), (None, 4, "open"), (1, None, "open")], "start long, end long, reason string")
    got = sorted((r["item_id"], r["incident_closed"]) for r in incidents.mark_incidents(df, spans).collect())
    assert got == [("a", True), ("a", True), ("b", False), ("c", False), ("d", False), ("e", False)]
    assert not any(told(incidents.mark_incidents(df, spans.limit(0))).values()) and incidents.mark_incidents(df.limit(0), spans).count() == 0


def test_a_hundred_thousand_windows(spark):
    base = round(T0.timestamp() * 1000)
    windows = spark.range(100_000).select((F.lit(base) + F.col("id") * 1000).alias("start"), (F.lit(base) + F.col("id") * 1000 + 10 + F.col("id") % 490).alias("end"))
    bins = incidents.window_bins(windows)
    assert bins.count() <= 200_000
    moments = [k * 1000 + d for k in (0, 1, 489, 99_999) for d in (0, 9, 10, 499, 500)]
    got = told(incidents.mark_incidents(items(spark, moments), windows))
    assert [got[f"i{k}"] for k in range(len(moments))] == [m % 1000 < 10 + m // 1000 % 490 for m in moments]


def test_one_automaton_equals_one_pattern_at_a_time(spark):
    patterns = ["*.py", "/*.min.js", "src/", "/src/api/", "docs", "/docs/x.md", "a", "*.", "/", "*", "api/src", "é/", "src", "*.py/"]
    paths = ["src/api/login.py", "/src/x", "docs/x.md", "lib/a.min.js", "x.py/", "", "/", "é/ü.py", "deep/src/api/", "file.", "*", "py", ".py"]
    df = spark.createDataFrame([(p, k, q) for p in paths for k, q in enumerate(patterns)], "path string, rule int, pattern string")
    want: dict = {p: [] for p in paths}
    for r in df.filter(text.path_matches(F.col("path"), F.col("pattern"))).orderBy("rule").collect():
        want[r["path"]].append(r["rule"])
    matcher = routing.RuleMatcher(list(enumerate(patterns)))
    assert {p: matcher.rules(p) for p in paths} == want
    assert routing.RuleMatcher([]).rules("a/b") == []


def test_many_rules_give_no_more_rows_than_hits(spark):
    rules = "".join(f"/src/part{k:05d}/ @team{k}\n" for k in range(20_000)) + "src @all\n"
    texts = spark.createDataFrame([(k, f"see src/part{k:05d}/x.py", None) for k in range(0, 20_000, 50)], "item_id long, title string, body string")
    began = time.monotonic()
    got = sorted((r["item_id"], r["rank"], r["owner"]) for r in routing.suggest_owners(texts, rules).collect())
    assert got == sorted(x for k in range(0, 20_000, 50) for x in ((k, 1, f"team{k}"), (k, 2, "all"))) and time.monotonic() - began < 60
    assert routing.suggest_owners(texts, "# none\n").count() == 0
