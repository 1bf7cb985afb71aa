"""Canonical JSON of one text, for Python workers. Imports nothing large, as every worker loads it."""

from __future__ import annotations

import json


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys, no blanks, ASCII only; null or invalid: null."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except ValueError:
        return None
