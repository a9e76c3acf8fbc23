"""Audit sampling: inclusion probabilities and the deterministic draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_draw(seed: Column, run_id: Column, task_id: Column) -> Column:
    """The first 64 bits of SHA-256 of ``seed|run|task`` as a number in [0, 1)."""
    digest = F.sha2(F.concat_ws("|", seed, run_id, task_id), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def selected(seed: Column, run_id: Column, task_id: Column, prob: Column) -> Column:
    return uniform_draw(seed, run_id, task_id) < prob


def inclusion_prob(confidence: Column, rate: float, bands: Sequence[tuple[float, float, float]] = (), floor: float = 0.0) -> Column:
    """The rate of the first band (lo, hi, rate) that holds the score, at least ``floor``.

    A band is closed above if its end is the largest end or 1 and more. Null and
    NaN scores, and those in no band, get the base rate.
    """
    for lo, hi, r in bands:
        if not (lo < hi and 0 <= r <= 1):
            raise ValueError(f"bad band {(lo, hi, r)}")
    top = max((hi for _, hi, _ in bands), default=1.0)
    known = confidence.isNotNull() & ~F.isnan(confidence)
    out = None
    for lo, hi, r in bands:
        inside = known & (confidence >= lo) & ((confidence <= hi) if hi >= min(top, 1.0) else (confidence < hi))
        out = F.when(inside, F.lit(float(r))) if out is None else out.when(inside, F.lit(float(r)))
    chosen = F.lit(float(rate)) if out is None else out.otherwise(F.lit(float(rate)))
    return F.greatest(F.lit(float(floor)), chosen)
