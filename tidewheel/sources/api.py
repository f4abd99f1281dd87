"""A Python data source for paged item listings, read once or followed as a stream; the transport is injected, so tests need no network.

    spark.dataSource.register(ItemPages)
    spark.read.format("item_pages").option("transport", "package.module:function").option("repo", "o/r").load()
    spark.readStream.format("item_pages")...  # each version of an item once, across restarts

A transport is ``function(repo, kind, state, cursor, size) -> (rows, next cursor or None)``, rows latest ``updated_at`` first. With
the option ``push``, filters choose what is asked of it (see ``FilteredReader``); Spark wants that to be allowed for the session too,
by ``spark.sql.python.filterPushdown.enabled``, and refuses the option where it is not.
"""

from __future__ import annotations

import importlib
import json
import time
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

#: ``record`` is the whole row as JSON, from which ``ingest.records`` takes what a kind of item needs.
SCHEMA = "number bigint, kind string, title string, body string, state string, author string, updated_at timestamp, created_at timestamp, record string"
ATTEMPTS = 5


class RateLimited(Exception):
    """The service asks to wait; ``seconds`` until it may be asked again."""

    def __init__(self, seconds: float = 1.0):
        super().__init__(f"rate limited for {seconds} s")
        self.seconds = seconds


class ItemPages(DataSource):
    """Options: transport, repo, kinds (pr,issue), state (open, closed, all), since (ISO), max_items, page_size, push (true), and

    point: ``function(repo, kind, number) -> row or None``, asked instead of pages where a pushed filter names numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "item_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("push") == "true" else PageReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


class _Listing:
    """What both readers ask of a transport."""

    def __init__(self, options):
        self.options = dict(options)
        self.kinds = self.options.get("kinds", "pr,issue").split(",")
        self.state = self.options.get("state", "open")

    def _rows(self, kind: str) -> Iterator[dict]:
        """Rows of a kind, latest first, page by page as they are taken, each number once: a row that slips to the next page comes twice."""
        fetch, most, size = _named(self.options["transport"]), int(self.options.get("max_items", 0)), int(self.options.get("page_size", 100))
        since = self.options.get("since")
        oldest = datetime.fromisoformat(since.replace("Z", "+00:00")) if since else None
        cursor, taken, told = None, 0, set()
        while True:
            rows, cursor = self._asked(f"{kind} pages", lambda at=cursor: fetch(self.options["repo"], kind, self.state, at, size))
            for row in rows:
                if oldest and row["updated_at"] < oldest.replace(tzinfo=row["updated_at"].tzinfo):
                    return
                if row["number"] not in told:
                    told.add(row["number"])
                    yield row
            taken += len(rows)
            if cursor is None or (most and taken >= most):
                return

    def _asked(self, what: str, call):
        for k in range(ATTEMPTS):
            try:
                return call()
            except RateLimited as wait:
                if k == ATTEMPTS - 1:
                    raise
                pause = min(wait.seconds * 2**k, 60)
                warnings.warn(f"{what} of {self.options['repo']}: rate limited, waiting {pause:g} s ({k + 1} of {ATTEMPTS})", stacklevel=2)
                time.sleep(pause)
        raise AssertionError("unreachable")


class PageReader(_Listing, DataSourceReader):
    """One task a kind."""

    after: datetime | None = None
    numbers: list[int] | None = None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.kinds]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # all partitions were filtered out
            return
        kind = partition.value
        if self.numbers is not None:
            point = _named(self.options["point"])
            found = (self._asked(f"{kind} {n}", lambda n=n: point(self.options["repo"], kind, n)) for n in self.numbers)
            yield from (_told(row, kind) for row in found if row is not None)
            return
        for row in self._rows(kind):
            if self.after and instant(row["updated_at"]) < self.after:
                return
            yield _told(row, kind)


class FilteredReader(PageReader):
    """A reader whose filters are pushed to the transport; Spark applies them again.

    ``kind`` leaves out partitions, ``updated_at`` over a time ends the paging there, ``state`` narrows a listing of ``all``
    states, and ``number`` asks for single items where the ``point`` option names how. The last two change which items a bound
    of the listing takes in, so they are pushed only where it has none.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        whole = self.options.get("state") == "all" and not {"since", "max_items"} & self.options.keys()
        point = whole and "point" in self.options
        for f in filters:
            match f:
                case GreaterThan(("updated_at",), time_) | GreaterThanOrEqual(("updated_at",), time_) | EqualTo(("updated_at",), time_) if time_ is not None:
                    self.after = max(filter(None, (self.after, instant(time_))))
                case EqualTo(("kind",), kind):
                    self.kinds = [k for k in self.kinds if k == kind]
                case In(("kind",), kinds):
                    self.kinds = [k for k in self.kinds if k in kinds]
                case EqualTo(("state",), state) if whole and str(state).lower() in ("open", "closed"):
                    self.state = state.lower()
                case EqualTo(("number",), number) if point:
                    self.numbers = [number] if self.numbers is None else [n for n in self.numbers if n == number]
                case In(("number",), numbers) if point:
                    self.numbers = [n for n in dict.fromkeys(numbers) if n is not None and (self.numbers is None or n in self.numbers)]
            yield f


@dataclass(frozen=True)
class Mark:
    """How far a kind was read: a time, and the numbers that were seen at exactly that time."""

    at: str = ""
    numbers: tuple[int, ...] = ()

    def covers(self, row: dict) -> bool:
        time_ = _text(row)
        return time_ < self.at or (time_ == self.at and row["number"] in self.numbers)

    def joined(self, other: Mark) -> Mark:
        """The further of two; at one time, what either has seen."""
        return Mark(self.at, tuple(sorted({*self.numbers, *other.numbers}))) if self.at == other.at else max(self, other, key=lambda m: m.at)


@dataclass
class Span(InputPartition):
    kind: str
    begin: Mark = field(default_factory=Mark)
    end: Mark = field(default_factory=Mark)


class PageStream(_Listing, DataSourceStreamReader):
    """A listing as a stream. An offset has, a kind, the latest ``updated_at`` and the numbers seen at that time.

    A batch is what the later offset covers and the earlier one does not, so records of equal times are neither told twice nor
    left out when one more of them appears. A record that changes between a batch's planning and its reading belongs to the
    next batch, in its new version. A listing whose latest record vanished does not set the offset back.
    """

    def __init__(self, options):
        super().__init__(options)
        self.furthest: dict[str, Mark] = {}

    def initialOffset(self) -> dict:
        return {k: {"at": "", "numbers": []} for k in self.kinds}

    def latestOffset(self) -> dict:
        out = {}
        for kind in self.kinds:
            latest, numbers = None, []
            for row in self._rows(kind):
                latest = latest or _text(row)
                if _text(row) != latest:
                    break
                numbers.append(row["number"])
            mark = Mark(latest or "", tuple(sorted(numbers))).joined(self.furthest.get(kind, Mark()))
            self.furthest[kind] = mark
            out[kind] = {"at": mark.at, "numbers": list(mark.numbers)}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = [Span(k, _mark(start, k), _mark(end, k)) for k in self.kinds]
        for s in spans:
            self.furthest[s.kind] = s.begin.joined(s.end).joined(self.furthest.get(s.kind, Mark()))
        return [s for s in spans if s.begin != s.end] or spans[:1]

    def read(self, partition: Span) -> Iterator[tuple]:
        for row in self._rows(partition.kind):
            if _text(row) < partition.begin.at:
                return
            if partition.end.covers(row) and not partition.begin.covers(row):
                yield _told(row, partition.kind)

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been told."""


def instant(value: datetime) -> datetime:
    """A time in UTC; one without a zone is local, as Spark takes it."""
    return value.astimezone(timezone.utc)


def _text(row: dict) -> str:
    """A row's time as text that sorts like the time."""
    return instant(row["updated_at"]).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _mark(offset: dict, kind: str) -> Mark:
    held = offset.get(kind) or {"at": "", "numbers": []}
    return Mark(held["at"], tuple(held["numbers"]))


def _named(path: str):
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


def _told(row: dict, kind: str) -> tuple:
    known = row | {"kind": kind, "record": json.dumps(row, default=_iso)}
    return tuple(known.get(c.split()[0]) for c in SCHEMA.split(", "))


def _iso(value) -> str:
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def estimated_calls(items: int, page: int = 100) -> int:
    return -(-items // page)
