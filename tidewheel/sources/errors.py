"""What went wrong with a service and what to do about it, without its secrets."""

from __future__ import annotations


class SourceError(Exception):
    """A failed call: its status where there was one, the reason and a remedy."""

    def __init__(self, reason: str, remedy: str, status: int | None = None):
        super().__init__(f"{reason}; {remedy}")
        self.reason, self.remedy, self.status = reason, remedy, status


#: HTTP status to reason and remedy.
REASONS = {
    401: ("the credentials were refused", "check the token"),
    403: ("access is forbidden or rate limited", "check the token's scopes, or wait"),
    404: ("not found", "check the name, and that the token may see it"),
    422: ("the request was not accepted", "check its parameters"),
    429: ("rate limited", "wait and try again"),
}


def redacted(text: str, secrets: tuple[str, ...] = ()) -> str:
    for secret in secrets:
        if secret:
            text = text.replace(secret, "[REDACTED]")
    return text


def classify(status: int | None, detail: str = "", secrets: tuple[str, ...] = ()) -> SourceError:
    """An HTTP status, or None where no answer came."""
    if status is None:
        return SourceError(f"no answer: {redacted(detail, secrets)}", "check the address and the network")
    if status >= 500:
        return SourceError("the service failed", "try again later", status)
    reason, remedy = REASONS.get(status, (f"status {status}", "see the service's documentation"))
    return SourceError(reason, remedy, status)
