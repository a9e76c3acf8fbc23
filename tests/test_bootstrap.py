"""Replicates against the same weights in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermeter.operators import bootstrap

REPS = 60


@pytest.fixture(scope="module")
def cases(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(r.integers(0, 20)) / 20, bool(r.random() < 0.5), float(r.integers(1, 5))) for k in range(300)]
    d = spark.createDataFrame(rows, "id long, score double, label boolean, w double")
    hashes = np.array([r.h for r in d.select(F.xxhash64("id").alias("h")).collect()])
    return d, rows, bootstrap.counts(hashes, REPS, 7)


def test_counts_are_poisson():
    drawn = bootstrap.counts(np.arange(20_000), 20, 3)[:, 1:]
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.03 and not np.array_equal(drawn, bootstrap.counts(np.arange(20_000), 20, 4)[:, 1:])


def check(got, values):
    lo, hi = np.quantile(values[1:], [0.025, 0.975])
    assert (got.value, got.lo, got.hi) == (pytest.approx(values[0]), pytest.approx(lo), pytest.approx(hi))


@pytest.mark.parametrize("parts", [1, 7])
def test_weighted_mean(cases, parts):
    d, rows, weight = cases
    y, w = np.array([r[2] for r in rows], dtype=float), np.array([r[3] for r in rows])
    got = bootstrap.ratio(d.repartition(parts, "score"), "id", F.col("label"), F.col("w"), reps=REPS, seed=7)
    check(got, [(c * w * y).sum() / (c * w).sum() for c in weight.T])


@pytest.mark.parametrize("held", [bootstrap.HELD_SUMS, 10])
def test_auroc(cases, monkeypatch, held):
    monkeypatch.setattr(bootstrap, "HELD_SUMS", held)
    d, rows, weight = cases
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def area(c):
        pos, neg = c[y], c[~y]
        beats = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
        return (pos[:, None] * neg[None, :] * beats).sum() / (pos.sum() * neg.sum())

    check(bootstrap.auroc(d, "id", reps=REPS, seed=7), [area(c) for c in weight.T])


def test_nothing_to_draw(cases):
    d, _, _ = cases
    assert bootstrap.auroc(d.limit(0), "id", reps=3) is None and bootstrap.auroc(d.where("label"), "id", reps=3) is None
    assert bootstrap.ratio(d, "id", F.lit(None), F.lit(1), reps=3) is None
