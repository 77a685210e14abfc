"""Driver-side display of numbers, times and values."""

from __future__ import annotations

import math
import re
from datetime import datetime


def number(n: float, digits: int = 1) -> str:
    """500, 2.5K, 1.5M, 2.0B."""
    if n < 0:
        return "-" + number(-n, digits)
    for unit, name in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if n >= unit:
            return f"{n / unit:.{digits}f}{name}"
    return f"{n:g}" if isinstance(n, float) and not n.is_integer() else str(int(n))


def duration(ms: float) -> str:
    """500ms, 2.5s, 1m 30s, 2h 5m."""
    if ms < 1000:
        return f"{max(0, math.floor(ms + 0.5))}ms"
    if ms < 60_000:
        return f"{ms / 1000:.1f}s"
    minutes = int(ms // 60_000)
    if minutes >= 60:
        return f"{minutes // 60}h {minutes % 60}m"
    return f"{minutes}m {math.floor((ms % 60_000) / 1000 + 0.5)}s"


def rate(per_second: float) -> str:
    """30.0/min, 50.0/s, 2.5K/s."""
    if per_second <= 0:
        return "0/s"
    if per_second < 1:
        return f"{per_second * 60:.1f}/min"
    scale, unit = (1, "") if per_second < 1e3 else (1e3, "K") if per_second < 1e6 else (1e6, "M")
    return f"{per_second / scale:.1f}{unit}/s"


def eta(ms: float) -> str:
    if math.isnan(ms) or ms == math.inf:
        return "calculating..."
    return "done" if ms <= 0 else f"ETA {duration(ms)}"


def truncate(text: str, width: int, mark: str = "...") -> str:
    if len(text) <= width:
        return text
    return mark[:width] if width <= len(mark) else text[: width - len(mark)] + mark


def visible(text: str) -> str:
    return re.sub("\x1b\\[[0-9;]*m", "", text)


# Fixed values of the log sanitiser.
LONGEST_TEXT, LONGEST_ARRAY, DEEPEST = 500, 3, 3
VECTOR_SIZES = (384, 512, 768, 1024, 1536, 3072)
KEEP = ("id", "score", "event", "component", "traceId", "spanId")
CUT = ("embedding", "vector", "payload", "results", "rawResponse", "fullParams")


def is_vector(value: object) -> bool:
    if not isinstance(value, (list, tuple)) or not value:
        return False
    numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value)
    return numeric and (len(value) in VECTOR_SIZES or len(value) > 100)


def sanitized(value: object, depth: int = 0, longest: int = LONGEST_ARRAY) -> object:
    """A value fit for a log line: long texts and arrays cut, vectors summed up, deep objects reduced to their keys."""
    if isinstance(value, str):
        return value if len(value) <= LONGEST_TEXT else f"{value[:LONGEST_TEXT]}... [truncated: {len(value)} chars total]"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, BaseException):
        return {"name": type(value).__name__, "message": str(value)}
    if isinstance(value, (list, tuple)):
        if is_vector(value):
            return f"[Embedding: dim={len(value)}, sample=[{', '.join(f'{v:.3f}' for v in value[:3])}, ...]]"
        items = [sanitized(v, depth + 1, longest) for v in value[:longest]]
        return items if len(value) <= longest else {"__arrayInfo__": {"length": len(value), "showing": longest, "items": items}}
    if isinstance(value, dict):
        if depth >= DEEPEST:
            return {"__keys__": list(value), "__depth__": "max depth exceeded"}
        return {k: _member(k, v, depth, longest) for k, v in value.items()}
    return value


def _member(key: str, value: object, depth: int, longest: int) -> object:
    if key in KEEP:
        return value
    if key in CUT:
        if isinstance(value, (list, tuple)):
            return sanitized(value, depth, 1)
        return {"__keys__": list(value)} if isinstance(value, dict) else value
    return sanitized(value, depth + 1, longest)
