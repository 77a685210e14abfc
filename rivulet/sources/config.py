"""Settings from a JSON file, overlaid by environment variables and checked."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Retrieval:
    limit: int = 10
    fusion: str = "rrf"
    rerank: bool = False


@dataclass(frozen=True)
class Chunking:
    most: int = 1000
    overlap: int = 100


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    chunking: Chunking = field(default_factory=Chunking)


def load(path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "RIVULET_") -> Config:
    """Sections are merged one level deep: defaults < file < PREFIX_SECTION_NAME variables."""
    given = {}
    if path:
        with open(path) as f:
            given = json.load(f)
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    sections = {}
    for section in fields(Config):
        kind = section.default_factory
        values = asdict(kind()) | given.get(section.name, {})
        for f in fields(kind):
            name = f"{prefix}{section.name}_{f.name}".upper()
            if name in env:
                values[f.name] = env[name]
        odd = set(values) - {f.name for f in fields(kind)}
        if odd:
            raise ValueError(f"unknown settings in {section.name}: {', '.join(sorted(odd))}")
        sections[section.name] = kind(**{k: _typed(v, getattr(kind(), k), f"{section.name}.{k}") for k, v in values.items()})
    config = Config(**sections)
    if config.retrieval.fusion not in ("rrf", "dbsf"):
        raise ValueError("retrieval.fusion must be rrf or dbsf")
    if config.retrieval.limit <= 0 or config.chunking.most <= 0 or not 0 <= config.chunking.overlap < config.chunking.most:
        raise ValueError("limits must be positive, and the overlap smaller than a chunk")
    return config


def _typed(value, like, name: str):
    if isinstance(like, bool):
        if isinstance(value, str) and value.lower() in ("true", "false"):
            return value.lower() == "true"
    elif isinstance(like, int) and isinstance(value, str):
        try:
            return int(value)
        except ValueError:
            raise ValueError(f"{name} must be a number: {value!r}") from None
    if type(value) is not type(like):
        raise ValueError(f"{name} must be {type(like).__name__}: {value!r}")
    return value
