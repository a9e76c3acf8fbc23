"""Confidence-gated cascade analytics on Spark."""

from __future__ import annotations

import importlib
from typing import Any

#: Public names and their modules; each is imported when it is first asked for.
_PUBLIC = {
    "tiermeter.config": ("Config", "ConfigError", "load", "parse"),
    "tiermeter.functions.estimators": ("estimator",),
    "tiermeter.functions.stats": ("Estimate", "bootstrap_ci", "clopper_pearson", "mcnemar_p", "required_n", "weighted_proportion", "wilson"),
    "tiermeter.functions.text": ("comparator", "compare", "extract", "extractor", "normalize_text"),
    "tiermeter.operators.audit": ("cases", "summarize", "weighted_cases"),
    "tiermeter.operators.cascade": ("AuditPolicy", "Tier", "complete_audits", "route"),
    "tiermeter.operators.montecarlo": ("bootstrap_mean", "coverage", "designs"),
    "tiermeter.operators.simulate": ("Answerer",),
    "tiermeter.operators.sweep": ("choose", "frontier", "items", "points", "recommend"),
    "tiermeter.sources.backends": ("Calls", "Command", "backend", "fingerprint"),
    "tiermeter.sources.ledger": ("Ledger",),
    "tiermeter.streaming.runner": ("Limits", "Runner", "Stopped"),
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str) -> Any:
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_MODULE_OF[name]), name)
