"""Settings from the environment, read once and checked; an unknown value fails loudly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

SWITCH = {"true": True, "1": True, "false": False, "0": False}


@dataclass(frozen=True)
class Settings:
    """Where the store is, and how the background drain runs."""

    store: str | None = None
    port: int = 8080
    gc_enabled: bool = True
    gc_grace_seconds: float = 60
    gc_interval_ms: int = 30_000
    gc_concurrency: int = 4


def _number(kind, least, text: str):
    value = kind(text)
    if not value >= least:
        raise ValueError(f"{text} is under {least}")
    return value


_READERS = {
    "store": lambda x: x or None,
    "port": lambda x: _number(int, 1, x),
    "gc_enabled": lambda x: SWITCH[x],
    "gc_grace_seconds": lambda x: _number(float, 0, x),
    "gc_interval_ms": lambda x: _number(int, 1, x),
    "gc_concurrency": lambda x: _number(int, 1, x),
}


def settings(env: Mapping[str, str] = os.environ) -> Settings:
    """OBJGROVE_STORE, OBJGROVE_GC_ENABLED and so on, by the fields' names."""
    found = {}
    for name, read in _READERS.items():
        key = f"OBJGROVE_{name.upper()}"
        if key in env:
            try:
                found[name] = read(env[key])
            except (ValueError, KeyError) as e:
                raise ValueError(f"{key}={env[key]!r} is not valid") from e
    return Settings(**found)
