"""Registry of the analytics queries."""

from __future__ import annotations

from . import analytics, audience, decisions, relational

_PLANS = (audience, relational, analytics, decisions)

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES

flagship = audience.flagship
