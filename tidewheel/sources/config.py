"""Settings of the engine and of single repositories, checked before any plan is built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import urlsplit

from tidewheel.functions.mapping import Window, compile_windows
from tidewheel.functions.scoring import Weights


@dataclass
class Thresholds:
    duplicate: float = 0.85
    aligned: float = 0.65
    drifting: float = 0.4


@dataclass
class Config:
    repos: list[str] = field(default_factory=list)
    vision_docs: dict[str, str] = field(default_factory=dict)
    vision_doc: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)
    bot_logins: tuple[str, ...] = ()
    include_bots: bool = False
    windows: list[Window] = field(default_factory=list)

    def vision_for(self, repo: str) -> str | None:
        return self.vision_docs.get(repo, self.vision_doc)


def load(text: str) -> Config:
    """Settings from YAML; unknown keys and values out of range are errors that name the key."""
    import yaml

    raw = yaml.safe_load(text) or {}
    known = {f.name for f in fields(Config)} | {"incident_windows", "repo"}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    t = Thresholds(**raw.get("thresholds", {}))
    for f in fields(Thresholds):
        if not 0 <= getattr(t, f.name) <= 1:
            raise ValueError(f"thresholds.{f.name} must lie in 0 to 1")
    return Config(
        repos=raw.get("repos") or ([raw["repo"]] if raw.get("repo") else []),
        vision_docs=raw.get("vision_docs") or {},
        vision_doc=raw.get("vision_doc"),
        thresholds=t,
        weights=Weights(**raw.get("weights", {})),
        bot_logins=tuple(raw.get("bot_logins") or ()),
        include_bots=bool(raw.get("include_bots", False)),
        windows=compile_windows(raw.get("incident_windows") or []),
    )


def environment(text: str) -> dict[str, str]:
    """Settings of a ``.env`` file: ``NAME=value`` lines, ``export`` and quotes allowed, comments and blank lines skipped."""
    out = {}
    for line in map(str.strip, text.split("\n")):
        name, eq, value = line.removeprefix("export ").partition("=")
        if eq and not line.startswith("#") and name.strip():
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


@dataclass
class ClusterSettings:
    include_bots: bool = False
    bot_logins: list[str] = field(default_factory=list)


@dataclass
class RepoSettings:
    similarity: float = 0.85
    auto_close: float = 0.95
    auto_close_enabled: bool = False
    incidents: list[dict] = field(default_factory=list)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)

    @property
    def windows(self) -> list[Window]:
        return compile_windows(self.incidents)


def repo_settings(text: str | None) -> RepoSettings:
    """Settings of one repository from JSON: a corrupt file gives defaults, a malformed setting is an error.

    What a file leaves out keeps its default, within ``cluster`` too. Each call gives settings of its own.
    """
    if not text:
        return RepoSettings()
    try:
        raw = json.loads(text)
    except ValueError:
        return RepoSettings()
    if not isinstance(raw, dict):
        return RepoSettings()
    inner = raw.get("cluster", {})
    if not isinstance(inner, dict):
        raise ValueError("cluster must be an object")
    known = lambda kind, given: {k: v for k, v in given.items() if k in {f.name for f in fields(kind)}}
    out = RepoSettings(**(known(RepoSettings, raw) | {"cluster": ClusterSettings(**known(ClusterSettings, inner))}))
    for name in ("similarity", "auto_close"):
        if isinstance(getattr(out, name), bool) or not isinstance(getattr(out, name), int | float) or not 0 <= getattr(out, name) <= 1:
            raise ValueError(f"{name} must lie in 0 to 1")
    for name, value in (("auto_close_enabled", out.auto_close_enabled), ("cluster.include_bots", out.cluster.include_bots)):
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false")
    if not isinstance(out.cluster.bot_logins, list) or not all(isinstance(x, str) and x.strip() for x in out.cluster.bot_logins):
        raise ValueError("cluster.bot_logins must be a list of logins")
    if not isinstance(out.incidents, list):
        raise ValueError("incidents must be a list")
    compile_windows(out.incidents)
    return out


def repo_settings_text(settings: RepoSettings) -> str:
    """The JSON that ``repo_settings`` reads back."""
    return json.dumps(asdict(settings), indent=2, sort_keys=True)


def provider_url(url: str) -> str:
    """A provider's address without a closing slash; only http(s), no credentials, query or fragment."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("a provider's address must be http or https")
    if parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("a provider's address may not hold credentials, a query or a fragment")
    return url.rstrip("/")
