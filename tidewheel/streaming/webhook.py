"""The edge before the stream: signatures are checked before an event is written to the source folder."""

from __future__ import annotations

import hashlib
import hmac
import json


def signature_ok(body: bytes, header: str | None, secret: str) -> bool:
    """``sha256=`` and the hex HMAC of the body, compared in constant time."""
    want = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return header is not None and hmac.compare_digest(want, header)


def event_row(body: bytes, event_type: str, event_id: int) -> dict | None:
    """A row of the event schema for an opened issue or pull request; others give none."""
    raw = json.loads(body)
    item = raw.get({"issues": "issue", "pull_request": "pull_request"}.get(event_type, ""))
    if raw.get("action") != "opened" or item is None:
        return None
    repo = raw["repository"]
    return {
        "event_id": event_id, "action": "opened", "event_type": event_type, "number": item["number"], "title": item.get("title") or "",
        "body": item.get("body") or "", "repo": {"owner": repo["owner"]["login"], "name": repo["name"], "full_name": repo["full_name"]},
        "sender": item["user"]["login"], "received_at": item.get("created_at"),
    }


def installed_repos(body: bytes, event_type: str) -> list[str]:
    """Full names of the repositories that an installation event brings; other events bring none."""
    raw = json.loads(body)
    key = {("installation", "created"): "repositories", ("installation_repositories", "added"): "repositories_added"}.get((event_type, raw.get("action")))
    return [r["full_name"] for r in raw.get(key) or [] if r.get("full_name")] if key else []
