"""The query catalog."""

from __future__ import annotations

from tiermeter.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from tiermeter.plans import audit_queries, curve_queries, scalar_queries  # noqa: F401  they register themselves


def all_queries() -> dict[str, Query]:
    _load()
    return QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return ORACLES
