"""What a request did: wall time by phase, counters, and the times of its queries; costs nothing outside a request."""

from __future__ import annotations

import time
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation


@dataclass
class Request:
    method: str
    path: str
    label: str | None = None
    phase: str | None = None
    phase_ms: dict[str, float] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    queries: list[dict] = field(default_factory=list)


_now: ContextVar[Request | None] = ContextVar("request", default=None)


@contextmanager
def request(method: str, path: str, done: list | None = None):
    """A collector for what runs inside; it is appended to `done` at the end, also after an error."""
    r = Request(method, path)
    token = _now.set(r)
    try:
        yield r
    finally:
        _now.reset(token)
        if done is not None:
            done.append(r)


@contextmanager
def phase(name: str):
    """Adds the wall time of what runs inside to a phase; an inner phase's queries are its own."""
    r = _now.get()
    if r is None:
        yield
        return
    outer, r.phase, began = r.phase, name, time.perf_counter()
    try:
        yield
    finally:
        r.phase_ms[name] = r.phase_ms.get(name, 0.0) + 1000 * (time.perf_counter() - began)
        r.phase = outer


def count(metric: str, n: int = 1) -> None:
    if r := _now.get():
        r.counters[metric] = r.counters.get(metric, 0) + n


def label(name: str) -> None:
    if r := _now.get():
        r.label = name


def record_query(text: str, ms: float) -> None:
    if r := _now.get():
        r.queries.append({"phase": r.phase, "query": text, "ms": ms})


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df with aggregates that Spark takes while it runs, and where they can be read afterwards."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o


def nearest_rank(values: list[float], p: float) -> float | None:
    """The p-th percentile by nearest rank; the smallest at 0, none of no values."""
    if not values:
        return None
    rank = -(-len(values) * p // 100)
    return sorted(values)[max(0, min(len(values), int(rank)) - 1)]
