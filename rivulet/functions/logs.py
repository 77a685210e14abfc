"""JSON log lines with sanitised values."""

from __future__ import annotations

import json
import logging

from .display import sanitized


class JsonFormatter(logging.Formatter):
    """One JSON object a line; ``extra={"data": {...}}`` adds fields, cut to a readable size."""

    def format(self, record: logging.LogRecord) -> str:
        data = sanitized(getattr(record, "data", {}))
        line = {"level": record.levelname.lower(), "component": record.name, "event": record.getMessage()}
        if record.exc_info and record.exc_info[1] is not None:
            line["error"] = sanitized(record.exc_info[1])
        return json.dumps(line | (data if isinstance(data, dict) else {"data": data}), default=str)


class CompactFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        data = sanitized(getattr(record, "data", {}))
        shown = " ".join(f"{k}={v}" for k, v in data.items()) if isinstance(data, dict) else str(data)
        return f"{record.levelname[0]} {record.name}: {record.getMessage()} {shown}".rstrip()


def logger(name: str, style: str = "json", level: int = logging.INFO) -> logging.Logger:
    if style not in ("json", "compact"):
        raise ValueError("style must be json or compact")
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonFormatter() if style == "json" else CompactFormatter())
        log.addHandler(handler)
    return log
