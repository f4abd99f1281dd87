"""Mapping of raw records to items, and the predicates over them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logins of automation that its reports leave unmarked.
BOT_LOGINS = (
    "dependabot", "dependabot-preview", "renovate", "github-actions", "greenkeeper", "snyk-bot",
    "imgbot", "allcontributors", "codecov", "mergify", "pre-commit-ci",
)


def pr_state(state: Column, merged_at: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").otherwise(F.lower(state))


def closed_at(rest: Column, graph: Column) -> Column:
    return F.coalesce(rest, graph)


def account_is_bot(typename: Column, kind: Column) -> Column:
    """True or false where either field says; null where neither is there."""
    return F.coalesce(typename, kind) == "Bot"


def closing_numbers(nodes: Column, repo: Column) -> Column:
    """Issue numbers of closing references into the same repository; no references is a known empty list."""
    same = F.filter(F.coalesce(nodes, F.array().cast("array<struct<number:bigint,repo:string>>")), lambda n: n["repo"] == repo)
    return F.transform(same, lambda n: n["number"])


def ci_status(rollup: Column) -> Column:
    """Null stays null: no report at all."""
    return (
        F.when(rollup.isNull(), F.lit(None).cast("string"))
        .when(rollup == "SUCCESS", "success")
        .when(rollup.isin("FAILURE", "ERROR"), "failure")
        .when(rollup.isin("PENDING", "EXPECTED"), "pending")
        .otherwise("unknown")
    )


def has_tests(paths: Column, total: Column) -> Column:
    """Any test-like path; unknown where more files changed than were listed."""
    found = F.exists(paths, lambda p: p.rlike("(?i)test|spec|__tests__"))
    return F.when(paths.isNull(), F.lit(None).cast("boolean")).when(found, True).when(total > 100, F.lit(None).cast("boolean")).otherwise(False)


def cluster_key(repo: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws(":", repo, kind, number.cast("string"))


def item_url(repo: Column, kind: Column, number: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo, F.when(kind == "pr", "/pull/").otherwise("/issues/"), number.cast("string"))


def normalized_login(login: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(login)), "^app/", "")


def is_bot(author: Column, author_is_bot: Column, extra: tuple[str, ...] = ()) -> Column:
    """The reported account type where known, else the login's form and the known and given logins."""
    login = normalized_login(F.coalesce(author, F.lit("")))
    names = [*BOT_LOGINS, *(re.sub("^app/", "", x.strip().lower()) for x in extra)]
    return F.coalesce(author_is_bot, login.endswith("[bot]") | login.isin(*names))


_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})")


@dataclass(frozen=True)
class Window:
    """A half-open span of epoch milliseconds in which closing was not a verdict."""

    start: int
    end: int
    reason: str


def compile_windows(entries: list[dict]) -> list[Window]:
    """Check declared windows before any plan is built; errors name the entry."""
    out = []
    for k, e in enumerate(entries):
        name = f"window {k} ({e.get('reason') or 'no reason'})"
        times = []
        for side in ("start", "end"):
            text = str(e.get(side, "")).strip()
            if not _INSTANT.fullmatch(text):
                raise ValueError(f"{name}: {side} needs a full ISO instant with an offset, not {text!r}")
            times.append(round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000))
        if times[1] <= times[0]:
            raise ValueError(f"{name}: the end must come after the start")
        out.append(Window(times[0], times[1], str(e.get("reason", ""))))
    return out


def incident_closed(state: Column, closed: Column, windows: list[Window]) -> Column:
    """Closed inside any window; derived when read, never stored."""
    hit = F.lit(False)
    millis = F.unix_millis(closed)
    for w in windows:
        hit = hit | ((millis >= w.start) & (millis < w.end))
    return F.coalesce((state == "closed") & hit, F.lit(False))


def parse_duration(text: str) -> timedelta:
    """``7d``, ``2w``, ``1m`` (thirty days)."""
    if not (m := re.fullmatch(r"(\d+)([dwm])", text)):
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]])


def since(text: str, now: datetime) -> datetime:
    return now.astimezone(timezone.utc) - parse_duration(text)


def earliest_window(windows: list[Window]) -> int | None:
    """Lower bound of a fetch of closed items; none is fetched without windows."""
    return min((w.start for w in windows), default=None)
