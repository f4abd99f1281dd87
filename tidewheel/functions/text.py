"""Text expressions: embedding input, titles, paths, diffs, repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instructions that a model family wants before its input.
TASK_PREFIX = {"nomic-embed-text": "clustering: "}
DIFF_LIMIT, DIFF_MARKER = 500_000, "\n... (truncated)"
#: White space at a text's ends, and what the pattern ``\\s`` of DuckDB takes as that, which has no vertical tab.
SPACE, SQL_SPACE = " \t\n\x0b\f\r", " \t\n\f\r"


def trim(text: Column, space: str = SPACE) -> Column:
    """Without white space at both ends; no pattern, which would try every white space of a long text."""
    return F.trim(text, F.lit(space))


def embedding_text(title: Column, body: Column, model: str | None = None, untitled: str | None = "Untitled", space: str = SPACE) -> Column:
    """Trimmed title, then the trimmed body's first 2,000 characters after a blank line.

    ``untitled`` stands for a null or empty title; with None an empty one stays empty, and a null one makes the whole text null.
    """
    named = title if untitled is None else F.when(F.coalesce(title, F.lit("")) == "", untitled).otherwise(title)
    head = trim(named, space)
    tail = F.substring(trim(F.coalesce(body, F.lit("")), space), 1, 2000)
    text = F.when(tail != "", F.concat(head, F.lit("\n\n"), tail)).otherwise(head)
    return F.concat(F.lit(task_prefix(model)), text)


def task_prefix(model: str | None) -> str:
    return TASK_PREFIX.get((model or "").split(":")[0], "")


def strip_controls(text: Column) -> Column:
    """Control characters become spaces, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1F\\x7F-\\x9F]", " "), "\\s+", " "))


def clean_title(text: Column, limit: int = 256) -> Column:
    return F.substring(strip_controls(text), 1, limit)


def table_cell(text: Column, limit: int = 60) -> Column:
    """A title for a markdown table: cut first, then pipes escaped, no backslash at the end."""
    return F.regexp_replace(F.replace(clean_title(text, limit), F.lit("|"), F.lit("\\|")), "\\\\+$", "")


def provider_input(text: Column) -> Column:
    """Text that an embedding provider accepts: no controls but tab and line ends, never empty."""
    cleaned = trim(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))
    return F.when(cleaned == "", " ").otherwise(cleaned)


def repo_parts(repo: Column) -> Column:
    """``owner`` and ``name`` of a repository given by URL, scp form or name; null if it has not two parts."""
    text = F.trim(repo)
    for pattern in ("^https?://github\\.com/", "^git@github\\.com:", "^github\\.com/", "\\.git$", "/$"):
        text = F.regexp_replace(text, pattern, "")
    parts = F.filter(F.split(text, "/"), lambda p: p != "")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("owner"), parts[1].alias("name")))


#: What counts as a path with a slash, a name between back-ticks, a name standing alone, and what is cut from a path's end.
PATH_WITH_SLASH = "(?:^|\\s|`|/|[(\\[\"'])([a-zA-Z0-9_\\-./]+/[a-zA-Z0-9_\\-./]*)"
PATH_TICKED = "`([a-zA-Z0-9_\\-./]+\\.[a-zA-Z]{1,10})`"
PATH_ALONE = "(?:^|\\s)([a-zA-Z0-9_\\-]+\\.[a-zA-Z]{1,10})(?:\\s|$|[,;:)])"
PATH_TAIL = "[.,;:)}\\]'\"]+$"


def paths(text: Column) -> Column:
    """File paths and names that a text mentions, each once, in order of kind and place."""
    found = lambda pattern: F.filter(F.regexp_extract_all(text, F.lit(pattern), 1), lambda p: F.length(p) > 2)
    with_slash = F.transform(found(PATH_WITH_SLASH), lambda p: F.regexp_replace(p, PATH_TAIL, ""))
    alone = F.filter(found(PATH_ALONE), lambda p: ~p.rlike("^\\d+\\.\\d+$"))
    return F.array_distinct(F.concat(with_slash, found(PATH_TICKED), alone))


def path_matches(path: Column, pattern: Column) -> Column:
    """Whether an ownership pattern covers a path: ``*.ext``, equal, prefix, or the directory inside it."""
    path, pattern = F.regexp_replace(path, "^/", ""), F.regexp_replace(pattern, "^/", "")
    inside = path.contains(F.regexp_replace(pattern, "/$", ""))
    return F.when(pattern.startswith("*."), path.endswith(F.substr(pattern, F.lit(2)))).otherwise(
        (path == pattern) | path.startswith(pattern) | inside
    )


def normalized_diff(diff: Column) -> Column:
    """A diff without index and hunk lines, trimmed."""
    lines = F.filter(F.split(diff, "\n"), lambda x: ~x.startswith("index ") & ~x.startswith("@@"))
    return trim(F.array_join(lines, "\n"))


def diff_fingerprint(diff: Column) -> Column:
    """SHA-256 of the normalised diff; null where nothing is left of it."""
    body = normalized_diff(diff)
    return F.when(body != "", F.sha2(body, 256))


def truncated_diff(diff: Column, limit: int = DIFF_LIMIT) -> Column:
    return F.when(F.length(diff) > limit, F.concat(F.substring(diff, 1, limit), F.lit(DIFF_MARKER))).otherwise(diff)


def redacted(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", value * 100)


def endpoint_identity(url: Column) -> Column:
    """A URL's origin and path: scheme and host in lower case, no credentials, default port, query, fragment or closing slash."""
    part = lambda k: F.regexp_extract(url, "^\\s*([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#]*@)?([^/?#]*)([^?#\\s]*)", k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    default = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("$^")
    return F.concat(scheme, F.lit("://"), F.regexp_replace(host, default, F.lit("")), F.regexp_replace(part(3), "/+$", ""))


def endpoint_fingerprint(url: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of a URL's origin and path."""
    return F.substring(F.sha2(endpoint_identity(url), 256), 1, 16)


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the timestamp's week."""
    return F.date_trunc("week", ts)


def first_json_object(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces in strings counted like others; null if none closes.

    The text is cut at braces only, so the walk is as long as there are braces.
    """
    start = F.locate("{", text)
    parts = F.split(F.substr(text, F.greatest(start, F.lit(1))), "(?=[{}])")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, c: F.struct(
            F.when(c.startswith("{"), a["d"] + 1).when(c.startswith("}"), a["d"] - 1).otherwise(a["d"]).alias("d"),
            (a["n"] + F.length(c)).alias("n"),
            F.when((a["end"] == 0) & c.startswith("}") & (a["d"] == 1), a["n"] + 1).otherwise(a["end"]).alias("end"),
        ),
        lambda a: a["end"],
    )
    return F.when((start > 0) & (depth > 0), F.substr(text, start, depth))
