"""Settings in TOML: which transcripts to read, what to spend at most, and what models cost."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from meterlight.sources.jsonl import Source, checked

# Where each vendor's tool keeps its transcripts, below the home folder.
DEFAULT_ROOTS = {"claude": ".claude/projects", "grok": ".grok/sessions", "codex": ".codex/sessions"}
WARN_PCT = 80


@dataclass(frozen=True)
class Limits:
    daily: float = 0.0
    weekly: float = 0.0
    warn_pct: int = WARN_PCT


def _read(path: str) -> dict | None:
    """None if there is no such file; a file that isn't TOML raises ``ValueError``."""
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except FileNotFoundError:
        return None


def default_sources(home: str) -> list[Source]:
    """The first vendor's folder, and those of the others that exist."""
    roots = {v: os.path.join(home, r) for v, r in DEFAULT_ROOTS.items()}
    return [Source(v, v, r) for k, (v, r) in enumerate(roots.items()) if k == 0 or os.path.isdir(r)]


def load_sources(path: str, home: str) -> list[Source]:
    """The ``[[source]]`` tables with vendor, label and root, checked; ``~`` is the home folder. Without a file the defaults."""
    read = _read(path) if path else None
    if read is None:
        return default_sources(home)
    given = read.get("source", [])
    if not given:
        raise ValueError("no sources in " + path)
    expanded = lambda r: home + r[1:] if r == "~" or r.startswith("~/") else r if "://" in r else os.path.normpath(r) if r else r
    return checked([Source(s.get("vendor", ""), s.get("label", ""), expanded(s.get("root", ""))) for s in given])


def load_limits(path: str) -> Limits:
    """``[limits]`` with daily, weekly and warn_pct; without a file none."""
    own = (_read(path) if path else None) or {}
    own = own.get("limits", {})
    warn = int(own.get("warn_pct", 0))
    return Limits(float(own.get("daily", 0.0)), float(own.get("weekly", 0.0)), warn if warn > 0 else WARN_PCT)
