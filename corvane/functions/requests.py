"""Validation of search and clip requests."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from ..schema import INCLUDE_FIELDS

MAX_TOP_K, DEFAULT_DIFF, MAX_IDS = 100, 0.1, 500
#: What a client is told of a bad request, part of the interface.
MESSAGES = {
    "query": "query is required and must be a string",
    "top_k": "top_k must be an integer between 1 and 100",
    "fraction": "{name} must be a finite number between 0 and 1 (inclusive)",
    "include": "include must be an array of: {names}",
    "format": "format must be 'markdown' or 'json'",
    "exclusive": "min_score and min_score_diff are mutually exclusive",
    "file_path": "filePath is required and must be a string",
    "lines": "startLine and endLine are required and must be finite numbers (1-indexed, inclusive)",
    "id": "id must be a positive integer",
    "ids": "ids is required",
    "id_list": "ids is required and must be an array of positive integers",
    "most_ids": "at most {n} ids",
    "id_or_ids": "provide either id or ids, not both and not neither",
}


class RequestError(ValueError):
    """A request that can't be served; ``status`` is the HTTP code."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def _number(x: Any) -> float:
    """A number as a lenient client means it: numeric text counts, empty text is 0, anything else is no number."""
    if isinstance(x, bool):
        return float(x)
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, str):
        try:
            return float(x.strip()) if x.strip() else 0.0
        except ValueError:
            return math.nan
    return math.nan


def coerce_top_k(x: Any) -> float | int:
    """1 to 100; absent, 0 and non-numbers give 100; fractions stay."""
    n = _number(x)
    n = MAX_TOP_K if x is None or math.isnan(n) or n == 0 else n
    n = min(max(1, n), MAX_TOP_K)
    return int(n) if float(n).is_integer() else n


def strict_top_k(x: Any) -> int:
    """An integer from 1 to 100; absent gives 100."""
    if x is None:
        return MAX_TOP_K
    if isinstance(x, bool) or not isinstance(x, int) or not 1 <= x <= MAX_TOP_K:
        raise RequestError(MESSAGES["top_k"])
    return x


def _fraction(x: Any, name: str) -> float | None:
    if x is None:
        return None
    n = _number(x)
    if not math.isfinite(n) or not 0 <= n <= 1:
        raise RequestError(MESSAGES["fraction"].format(name=name))
    return n


def check_include(x: Any) -> tuple[str, ...]:
    if x is None:
        return ()
    if not isinstance(x, (list, tuple)) or any(f not in INCLUDE_FIELDS for f in x):
        raise RequestError(MESSAGES["include"].format(names=", ".join(INCLUDE_FIELDS)))
    return tuple(dict.fromkeys(x))


def check_format(x: Any) -> str:
    if x is None or x == "":
        return "markdown"
    if x not in ("markdown", "json"):
        raise RequestError(MESSAGES["format"])
    return x


@dataclass(frozen=True)
class SearchRequest:
    query: str
    top_k: float | int = MAX_TOP_K
    filters: dict[str, str] = field(default_factory=dict)
    min_score: float | None = None
    min_score_diff: float | None = DEFAULT_DIFF
    include: tuple[str, ...] = ()
    format: str = "markdown"


def parse_search(body: dict[str, Any], *, strict: bool = False) -> SearchRequest:
    """Checked in order: query, format, include, min_score, exclusion, min_score_diff."""
    query = body.get("query")
    if not isinstance(query, str) or not query:
        raise RequestError(MESSAGES["query"])
    top_k = (strict_top_k if strict else coerce_top_k)(body.get("top_k"))
    shape, include = check_format(body.get("format")), check_include(body.get("include"))
    low = _fraction(body.get("min_score"), "min_score")
    if low is not None and body.get("min_score_diff") is not None:
        raise RequestError(MESSAGES["exclusive"])
    diff = _fraction(body.get("min_score_diff"), "min_score_diff")
    if diff is None and low is None:
        diff = DEFAULT_DIFF
    filters = {c: str(body[c]) for c in ("module", "language", "chunk_type") if body.get(c)}
    return SearchRequest(query, top_k, filters, low, diff, include, shape)


def parse_id(raw: Any) -> int:
    text = str(raw)
    if not re.fullmatch(r"[0-9]+", text) or int(text) < 1:
        raise RequestError(MESSAGES["id"])
    return int(text)


def parse_ids(raw: Any, *, distinct: bool = False) -> list[int]:
    """Ids from a list, repeated values or comma-separated text; one bad token rejects all."""
    parts = raw if isinstance(raw, (list, tuple)) else [raw]
    ids = [parse_id(t.strip()) for p in parts for t in str(p).split(",") if t.strip()]
    if not ids:
        raise RequestError(MESSAGES["ids"])
    if len(ids) > MAX_IDS and not distinct:
        raise RequestError(MESSAGES["most_ids"].format(n=MAX_IDS))
    return list(dict.fromkeys(ids)) if distinct else ids
