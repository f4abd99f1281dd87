"""Reviews by a language model: the provider protocol, checked answers, one retry in plain text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFF_CHARACTERS = 50_000
RECOMMENDATIONS = ("merge", "revise", "close")
DDL = "item_id string, summary string, concerns array<string>, recommendation string, confidence double, error string"


class LLMProvider(Protocol):
    """What a completion service must offer; instances are sent to executors."""

    name: str
    model: str

    def complete(self, prompt: str) -> str: ...

    def complete_json(self, prompt: str) -> str: ...


def first_object(text: str) -> str | None:
    """The first balanced ``{...}``; braces inside strings count like others."""
    start, depth = text.find("{"), 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start : i + 1]
    return None


def parsed(text: str) -> dict | None:
    """A review that has every field in its form, or nothing."""
    try:
        got = json.loads(first_object(text) or "")
    except ValueError:
        return None
    ok = (
        isinstance(got, dict)
        and isinstance(got.get("summary"), str)
        and isinstance(got.get("concerns"), list)
        and all(isinstance(c, str) for c in got["concerns"])
        and got.get("recommendation") in RECOMMENDATIONS
        and isinstance(got.get("confidence"), int | float)
        and 0 <= got["confidence"] <= 1
    )
    return got if ok else None


def review(items: DataFrame, provider: LLMProvider, kind: str | None = None, top: int | None = None) -> DataFrame:
    """A review of each item (title, body, patch_text); ``kind`` and ``top`` choose the most recently updated."""
    chosen = items if kind is None else items.filter(F.col("type") == kind)
    chosen = chosen if top is None else chosen.orderBy(F.desc("updated_at"), "item_id").limit(top)
    prompt = F.concat_ws("\n\n", "title", "body", F.left(F.coalesce("patch_text", F.lit("")), F.lit(DIFF_CHARACTERS)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["prompt"], strict=True):
                try:
                    got = parsed(provider.complete_json(text)) or parsed(provider.complete(text))
                    error = None if got else "no valid review"
                except Exception as e:  # noqa: BLE001 - a provider's failure is a row, not a failed job
                    got, error = None, type(e).__name__
                got = got or {}
                rows.append((item, got.get("summary"), got.get("concerns"), got.get("recommendation"), float(got["confidence"]) if got else None, error))
            yield pd.DataFrame(rows, columns=["item_id", "summary", "concerns", "recommendation", "confidence", "error"])

    return chosen.select("item_id", prompt.alias("prompt")).mapInPandas(run, DDL)
