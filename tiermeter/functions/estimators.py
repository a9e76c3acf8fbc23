"""Confidence estimators by name: functions from an answer's columns to its score."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tiermeter.functions import exprs
from tiermeter.functions.text import made

#: From columns by name (``text``, ``answer``, ``logprobs``, ``votes``, ``monitor_text``) to a score in [0, 1] or null.
Estimator = Callable[[Mapping[str, Column]], Column]


def _column(columns: Mapping[str, Column], name: str) -> Column:
    if name not in columns:
        raise ValueError(f"the estimator needs a column {name!r}")
    return columns[name]


def verbal(allow_words: bool = False) -> Estimator:
    """What the reply says; nothing for an empty answer."""

    def score(columns: Mapping[str, Column]) -> Column:
        said = exprs.verbal_confidence(_column(columns, "text"), words=allow_words)
        return F.when(F.trim(F.coalesce(_column(columns, "answer"), F.lit(""))) != "", said) if "answer" in columns else said

    return score


def logprob(aggregate: str = "mean") -> Estimator:
    if aggregate not in ("mean", "min", "geo_mean"):
        raise ValueError("aggregate is mean, min or geo_mean")
    return lambda columns: exprs.logprob_confidence(_column(columns, "logprobs"), aggregate)


def self_consistency() -> Estimator:
    """How many of the further samples agree with the answer."""
    from tiermeter.operators.simulate import self_consistency as share

    return lambda columns: share(_column(columns, "votes"), _column(columns, "answer"))


def monitor(allow_words: bool = False) -> Estimator:
    """What another model's reply says of the answer."""
    return lambda columns: exprs.verbal_confidence(_column(columns, "monitor_text"), monitor=True, words=allow_words)


def function(call: Callable, columns: tuple[str, ...] = ("text", "answer")) -> Estimator:
    """A Python function of the named columns' values, clamped to [0, 1]; NaN, None and failures are unknown."""

    def one(values: tuple) -> float | None:
        try:
            v = call(*values)
            return None if v is None or v != v else min(1.0, max(0.0, float(v)))
        except Exception:  # noqa: BLE001  a user's function may fail on a reply
            return None

    def score(given: Mapping[str, Column]) -> Column:
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([one(v) for v in zip(*series, strict=True)], dtype=object)

        run.__annotations__ = {}
        return F.pandas_udf(run, "double", functionType=200)(*[_column(given, c) for c in columns])

    return score


def combine(parts: list | tuple, method: str = "mean", weights: list | tuple | None = None, ignore_missing: bool = False) -> Estimator:
    if not parts:
        raise ValueError("parts: one at least")
    made_ = [estimator(p) for p in parts]
    exprs.combined([F.lit(0.5) for _ in made_], method, weights, ignore_missing)  # a mistake shows now
    return lambda columns: exprs.combined([e(columns) for e in made_], method, weights, ignore_missing)


def calibrated(base: str | dict, points: list | tuple) -> Estimator:
    """Another estimator's score through a piecewise linear map."""
    inner, knots = estimator(base), [(float(x), float(y)) for x, y in points]
    if not knots or knots != sorted(knots):
        raise ValueError("points: pairs with rising first numbers")
    return lambda columns: exprs.piecewise(inner(columns), knots)


ESTIMATORS: dict[str, Callable[..., Estimator]] = {"verbal": verbal, "logprob": logprob, "self_consistency": self_consistency, "monitor": monitor, "function": function, "combine": combine, "calibrated": calibrated}


def estimator(spec: str | dict | None) -> Estimator:
    """From a name or a table of ``type`` and options, nested for ``combine`` and ``calibrated``."""
    return made(ESTIMATORS, spec, "verbal", "estimator")
