"""Every query of the engine's own operators, with its SQL."""

from __future__ import annotations

from .queries import drift, evaluation, features, models, planning, prep, profile  # noqa: F401 - they register themselves
from .queries.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
