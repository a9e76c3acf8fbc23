"""Configuration files in TOML: tiers, audit, ledger."""

from __future__ import annotations

import difflib
import tomllib
from dataclasses import dataclass
from typing import Any

from tiermeter.functions import estimators, text
from tiermeter.operators.cascade import AuditPolicy, Tier
from tiermeter.sources import backends

_KNOWN = {"": ("ledger", "run", "tiers", "audit"), "tiers": ("name", "backend", "threshold", "options", "estimator", "extractor", "comparator"), "audit": ("mode", "rate", "bands", "floor", "seed", "tolerance"), "run": ("id", "mode", "note")}


class ConfigError(ValueError):
    """A mistake in a file, with the path to it."""


@dataclass(frozen=True)
class Config:
    raw: dict[str, Any]
    ledger: str
    run_id: str
    mode: str
    tiers: tuple[Tier, ...]
    audit: AuditPolicy
    tolerance: float | None


def _check(section: str, where: str, given: dict) -> None:
    for k in given:
        if k not in _KNOWN[section]:
            near = difflib.get_close_matches(k, _KNOWN[section], 1)
            raise ConfigError(f"{where}{k}: unknown" + (f"; did you mean {near[0]}?" if near else ""))


def parse(raw: dict[str, Any]) -> Config:
    _check("", "", raw)
    run, audit = raw.get("run", {}), dict(raw.get("audit", {}))
    _check("run", "run.", run)
    _check("audit", "audit.", audit)
    tiers = []
    for i, t in enumerate(raw.get("tiers", [])):
        where = f"tiers[{i}]."
        _check("tiers", where, t)
        if "name" not in t or t.get("backend") not in backends.BACKENDS:
            raise ConfigError(f"{where}backend: known are {', '.join(backends.BACKENDS)}")
        if any("key" in k and not k.endswith("_env") for k in t.get("options", {})):
            raise ConfigError(f"{where}options: secrets come from environment variables, by names ending in _env")
        parts = {}
        for part, made in (("estimator", estimators.estimator), ("extractor", text.extractor), ("comparator", text.comparator)):
            try:
                made(t.get(part))
            except (ValueError, TypeError) as e:
                raise ConfigError(f"{where}{part}: {e}") from e
            if t.get(part) is not None:
                parts[part] = t[part]
        last = i == len(raw["tiers"]) - 1
        threshold = t.get("threshold")
        if (threshold is None) != last or (threshold is not None and not 0 <= threshold <= 1):
            raise ConfigError(f"{where}threshold: between 0 and 1 for all tiers but the last")
        try:
            backend = backends.backend(t["backend"], t["name"], t.get("options", {}), **parts)
        except (ValueError, TypeError) as e:
            raise ConfigError(f"{where}options: {e}") from e
        tiers.append(Tier(t["name"], backend, threshold))
    if not tiers or len({t.name for t in tiers}) < len(tiers):
        raise ConfigError("tiers: one at least, with different names")
    tolerance = audit.pop("tolerance", None)
    try:
        policy = AuditPolicy(**{k: tuple(map(tuple, v)) if k == "bands" else v for k, v in audit.items()})
    except ValueError as e:
        raise ConfigError(f"audit: {e}") from e
    return Config(raw, raw.get("ledger", "ledger"), run.get("id", "run"), run.get("mode", "serve"), tuple(tiers), policy, tolerance)


def load(path: str) -> Config:
    with open(path, "rb") as f:
        try:
            return parse(tomllib.load(f))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e
