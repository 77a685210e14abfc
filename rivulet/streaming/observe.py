"""Metadata and progress: observed metrics, stream progress, and a progress tracker for drivers."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import display


class Observed:
    """A pass-through of a frame whose metrics are there once an action ran."""

    def __init__(self, df: DataFrame, name: str, **metrics: Column):
        self._observation = Observation(name)
        self.df = df.observe(self._observation, *(c.alias(n) for n, c in metrics.items()))

    def get(self) -> dict:
        return self._observation.get


#: Smoothing of the rate, its window, and how many latencies are kept.
SMOOTHING, RATE_WINDOW_S, KEPT = 0.3, 1.0, 10_000


@dataclass
class Collector:
    """Counts, throughput and the last latencies of a driver-side loop."""

    clock: Callable[[], float] = time.monotonic
    processed: int = 0
    failed: int = 0
    skipped: int = 0
    began: float | None = None
    first: float | None = None
    ended: float | None = None
    latencies: deque = field(default_factory=lambda: deque(maxlen=KEPT))
    _open: float | None = None

    def start(self) -> None:
        self._open = self.clock()
        self.began = self._open if self.began is None else self.began

    def end(self, ok: bool = True) -> None:
        now = self.clock()
        self.first = now if self.first is None else self.first
        if self._open is not None:
            self.latencies.append((now - self._open) * 1000)
        self.processed += ok
        self.failed += not ok

    def skip(self) -> None:
        self.skipped += 1

    def complete(self) -> None:
        self.ended = self.clock()

    def snapshot(self) -> dict:
        now = self.ended if self.ended is not None else self.clock()
        span = max(now - self.began, 1e-9) if self.began is not None else 0.0
        values = sorted(self.latencies)
        at = lambda p: values[max(0, -(-p * len(values) // 100) - 1)] if values else 0.0
        return {
            "processed": self.processed, "failed": self.failed, "skipped": self.skipped,
            "throughput": (self.processed + self.failed) / span if span else 0.0,
            "time_to_first_ms": (self.first - self.began) * 1000 if self.first is not None and self.began is not None else None,
            "min": values[0] if values else 0.0, "max": values[-1] if values else 0.0, "avg": sum(values) / len(values) if values else 0.0,
            "p50": at(50), "p95": at(95), "p99": at(99),
        }


class Tracker:
    """Rows in and out of each step, a smoothed rate, expansion ratios and an estimate of the time left."""

    def __init__(self, steps: list[str], total: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.steps = {s: {"in": 0, "out": 0, "errors": 0} for s in steps}
        self.total, self._clock = total, clock
        self._listeners: list[Callable[[dict], None]] = []
        self._began = self._last = clock()
        self._since, self.rate = 0, 0.0
        self._emit("start")

    def listen(self, listener: Callable[[dict], None]) -> None:
        self._listeners.append(listener)

    def _emit(self, kind: str, **more) -> None:
        for listener in self._listeners:
            listener({"type": kind, "at": self._clock() - self._began, **more})

    def record(self, step: str, rows_in: int = 0, rows_out: int = 0, errors: int = 0) -> None:
        s = self.steps[step]
        s["in"] += rows_in
        s["out"] += rows_out
        s["errors"] += errors
        self._since += rows_out
        span = self._clock() - self._last
        if span >= RATE_WINDOW_S:
            now = self._since / span
            self.rate = now if self.rate == 0 else SMOOTHING * now + (1 - SMOOTHING) * self.rate
            self._last, self._since = self._clock(), 0
        self._emit("error" if errors else "progress", step=step, **s)

    def expansion(self, step: str) -> float | None:
        s = self.steps[step]
        return s["out"] / s["in"] if s["in"] else None

    def eta_ms(self) -> float:
        done = next(iter(self.steps.values()))["in"]
        if self.total is None or self.rate <= 0:
            return float("inf")
        return max(0.0, (self.total - done) / self.rate * 1000)

    def complete(self) -> str:
        self._emit("complete")
        return self.summary()

    def summary(self) -> str:
        lines = [f"{name}: {display.number(s['in'])} in, {display.number(s['out'])} out" + (f", {s['errors']} errors" if s["errors"] else "") for name, s in self.steps.items()]
        return "\n".join([*lines, f"took {display.duration((self._clock() - self._began) * 1000)}"])


class StreamProgress(StreamingQueryListener):
    """Keeps the last progress of each streaming query."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}
        self.errors: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = {"rows": 0, "rate": 0.0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = self.last.setdefault(str(p.id), {"rows": 0, "rate": 0.0})
        self.last[str(p.id)] = {"rows": seen["rows"] + p.numInputRows, "rate": p.processedRowsPerSecond, "batch": p.batchId}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)
