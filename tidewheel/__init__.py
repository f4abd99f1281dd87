"""Work-item triage analytics expressed as Spark DataFrame plans.

The names below are what a program that uses the library needs; they are imported when first used.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_PLACES = {
    "operators.clusters": ("find_clusters", "refine", "item_components"),
    "operators.similarity": ("similar_pairs", "similar_edges", "vector_classes", "cross_pairs", "one_against_all", "nearest", "compare", "best_section", "pair_statistics"),
    "operators.components": ("connected_components",),
    "operators.canonical": ("decide", "tracker_roles", "relations", "closing_edges"),
    "operators.identity": ("confirmed",),
    "operators.incidents": ("mark_incidents", "window_table"),
    "operators.stats": ("overlap", "cluster_pairs", "greedy_matches", "dimension_study", "repo_stats", "coverage"),
    "functions.scoring": ("rank_signals", "rank_score", "cluster_score", "confidence"),
    "functions.vectors": ("cosine", "is_zero", "unit"),
    "functions.text": ("embedding_text", "repo_parts"),
    "functions.mapping": ("parse_duration", "compile_windows"),
    "sources.config": ("load", "environment", "repo_settings"),
    "sources.errors": ("classify", "SourceError"),
    "sources.ingest": ("embed", "upsert", "classify_changes", "fetched_items", "EmbeddingProvider", "HashingEmbedder"),
    "sources.reviews": ("review", "LLMProvider"),
    "sources.scan": ("scan", "ScanReport"),
    "sources.store": ("Store",),
    "plans.export": ("contract_clusters", "report", "report_json", "checklist", "WriteGate"),
    "plans.digest": ("weekly_digest", "backlog_report", "digest_totals"),
    "streaming.authors": ("author_counts", "keep_authors"),
    "streaming.triage": ("match_batch", "triage_stream", "read_events"),
}
_HOME = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
