"""The paged source: filters reach the transport, and a stream of it tells each version of an item once."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewheel.sources.api import ItemPages, Mark

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _log(folder, **what):
    with open(f"{folder}/calls", "a") as f:
        f.write(json.dumps(what) + "\n")


def pages(repo, kind, state, cursor, size):
    """Records of a folder named by the repository; every call is noted there."""
    with open(f"{repo}/rows") as f:
        rows = [r | {"updated_at": T0 + timedelta(hours=r["hour"]), "created_at": T0} for r in map(json.loads, f) if r["kind"] == kind]
    rows = sorted((r for r in rows if state in ("all", r["state"].lower())), key=lambda r: (-r["hour"], r["number"]))
    at = cursor or 0
    _log(repo, kind=kind, state=state, at=at)
    return rows[at : at + size], at + size if at + size < len(rows) else None


def point(repo, kind, number):
    _log(repo, kind=kind, number=number)
    return next((r for r in pages(repo, kind, "all", 0, 1000)[0] if r["number"] == number), None)


class Listing:
    def __init__(self, folder):
        self.folder = folder
        self.rows = {}

    def put(self, *rows):
        """(number, kind, hour, state)"""
        for number, kind, hour, state in rows:
            self.rows[(number, kind)] = {"number": number, "kind": kind, "hour": hour, "state": state, "title": f"t{number}", "body": "", "author": "a"}
        (self.folder / "rows").write_text("".join(json.dumps(r) + "\n" for r in self.rows.values()))

    def drop(self, number, kind):
        del self.rows[(number, kind)]
        self.put()

    def calls(self):
        path = self.folder / "calls"
        out = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
        path.write_text("")
        return out


@pytest.fixture
def listing(spark, tmp_path):
    spark.dataSource.register(ItemPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = Listing(tmp_path)
    out.put(*[(n, "pr" if n % 2 else "issue", n, "OPEN" if n % 3 else "CLOSED") for n in range(1, 41)])
    yield out
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def reader(of, listing, **options):
    return of.format("item_pages").options(transport="tests.test_source:pages", repo=str(listing.folder), page_size=4, **options)


def pushed(spark, listing, **options):
    return reader(spark.read, listing, state="all", push="true", **options).load()


def test_filters_reach_the_transport(spark, listing):
    df = pushed(spark, listing)
    assert df.count() == 40 and len(listing.calls()) == 10
    late = df.filter(F.col("updated_at") >= F.lit(T0 + timedelta(hours=35)))
    assert sorted(r["number"] for r in late.collect()) == [35, 36, 37, 38, 39, 40] and len(listing.calls()) == 2
    assert sorted(r["number"] for r in late.filter(F.col("updated_at") > F.lit(T0 + timedelta(hours=38))).collect()) == [39, 40]
    listing.calls()
    assert df.filter("kind = 'pr' and state = 'CLOSED'").count() == 7
    assert {(c["kind"], c["state"]) for c in listing.calls()} == {("pr", "closed")}
    assert df.filter("kind = 'none'").count() == 0 and listing.calls() == []
    # a listing of open items has no closed ones, whatever is asked
    assert reader(spark.read, listing, push="true").load().filter("state = 'CLOSED'").count() == 0


def test_single_items_are_asked_for_by_number(spark, listing):
    df = pushed(spark, listing, point="tests.test_source:point")
    assert [r["number"] for r in df.filter("kind = 'pr' and number = 7").collect()] == [7]
    assert [c["number"] for c in listing.calls() if "number" in c] == [7]
    assert sorted(r["number"] for r in df.filter("number in (7, 8, 99)").collect()) == [7, 8]
    assert df.filter("number in (7, 8) and number = 9").count() == 0
    assert pushed(spark, listing).filter("number = 7").count() == 1


def test_pushed_or_not_the_rows_are_the_same(spark, listing):
    asked = ["updated_at > timestamp'2024-03-02 05:00:00'", "updated_at = timestamp'2024-03-02 05:00:00'", "state = 'OPEN' or number = 3", "kind in ('issue') and number > 30", "updated_at is null"]
    with_ = [sorted(r["number"] for r in pushed(spark, listing).filter(x).collect()) for x in asked]
    assert with_ == [sorted(r["number"] for r in reader(spark.read, listing, state="all").load().filter(x).collect()) for x in asked] and all(with_[:4])


def drained(spark, listing, folder):
    """What one run of the stream tells, from where the last one ended."""
    told = []
    made = reader(spark.readStream, listing, state="all").load()
    q = made.writeStream.foreachBatch(lambda df, _: told.extend((r["number"], r["kind"]) for r in df.collect())).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return sorted(told)


def test_stream_neither_repeats_nor_loses_records_of_equal_times(spark, listing, tmp_path):
    listing.rows.clear()
    listing.put((1, "pr", 5, "OPEN"), (2, "pr", 5, "OPEN"), (3, "issue", 1, "OPEN"))
    folder = tmp_path / "offsets"
    assert drained(spark, listing, folder) == [(1, "pr"), (2, "pr"), (3, "issue")]
    assert drained(spark, listing, folder) == []
    listing.put((4, "pr", 5, "OPEN"), (5, "issue", 1, "OPEN"))  # at the very times that were told
    assert drained(spark, listing, folder) == [(4, "pr"), (5, "issue")]
    listing.put((1, "pr", 9, "CLOSED"))  # a new version
    assert drained(spark, listing, folder) == [(1, "pr")]
    listing.drop(1, "pr")  # the latest one vanishes: nothing is told again
    assert drained(spark, listing, folder) == []
    listing.put((6, "pr", 10, "OPEN"))
    assert drained(spark, listing, folder) == [(6, "pr")]


def test_marks():
    a, b = Mark("1", (1, 2)), Mark("1", (3,))
    assert a.joined(b) == Mark("1", (1, 2, 3)) and a.joined(Mark("2", (9,))) == Mark("2", (9,)) and Mark().joined(a) == a
