"""The library's queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from folio.operators import attribution, events, matching, profiles, quality, routing, scripts, sequential, text
from folio.streaming import streams

MODULES = [quality, text, scripts, attribution, matching, routing, events, sequential, streams, profiles]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
