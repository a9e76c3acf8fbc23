import itertools
import random

import pytest
from pyspark.sql import functions as F

from tiermeter.functions.intervals import reached, value_at
from tiermeter.operators import calibrate, sweep


def max_min(rows):
    """The isotonic fit by its identity: the highest over starts of the least over ends of the mean between."""
    per = {}
    for s, y in rows:
        if s is not None and s == s:
            k, n = per.get(s, (0, 0))
            per[s] = (k + bool(y), n + 1)
    xs = sorted(per)
    fits = {}
    for i, x in enumerate(xs):
        best = 0.0
        for a in range(i + 1):
            low = min(sum(per[v][0] for v in xs[a : b + 1]) / sum(per[v][1] for v in xs[a : b + 1]) for b in range(i, len(xs)))
            best = max(best, low)
        fits[x] = best
    return fits


def rows_of(seed, n=60):
    r = random.Random(seed)
    return [(round(r.random(), 9) if k % 4 else round(r.random(), 1), r.random() < 0.3 + 0.4 * r.random()) for k in range(n)]


@pytest.mark.parametrize("edges", [calibrate.MOST_EDGES, 0])
def test_isotonic_fit_is_the_max_min_identity(spark, monkeypatch, edges):
    monkeypatch.setattr(calibrate, "MOST_EDGES", edges)
    rows = rows_of(1) + [(None, True), (float("nan"), False), (0.25, None), (-3.5, True), (7.0, False)]
    got = calibrate.isotonic_table(spark.createDataFrame(rows, "score double, label boolean")).collect()
    want = max_min(rows)
    assert {r.score: pytest.approx(r.fitted, abs=1e-12) for r in got} == want and len(got) == len(want)


def test_knots_are_the_ends_of_blocks(spark):
    for seed in (2, 3):
        rows = rows_of(seed)
        want = max_min(rows)
        runs = [list(g) for _, g in itertools.groupby(sorted(want), key=lambda x: round(want[x], 12))]
        knots = calibrate.fit_isotonic(spark.createDataFrame(rows, "score double, label boolean"))
        ends = [(x, want[x]) for run in runs for x in dict.fromkeys((run[0], run[-1]))]
        assert [k[0] for k in knots] == [e[0] for e in ends] and [k[1] for k in knots] == pytest.approx([e[1] for e in ends])


def test_fits_without_rows_or_with_one_class(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, label boolean")
    assert calibrate.fit_isotonic(frame([])) == [] and calibrate.isotonic_table(frame([(None, True)])).count() == 0
    assert calibrate.fit_isotonic(frame([(0.1, True), (0.7, True)])) == [(0.1, 1.0), (0.7, 1.0)]


def test_a_map_of_many_blocks(spark):
    """Labels that rise with the score throughout: each score is a block of its own."""
    rows = spark.range(400).select((F.col("id") / 400).alias("score"), F.explode(F.sequence(F.lit(1), F.lit(400))).alias("j"), "id").select("score", (F.col("j") <= F.col("id")).alias("label"))
    blocks = calibrate.isotonic_blocks(rows)
    assert blocks.count() == 400 and blocks.where("k <> round(lo * 400) or n <> 400").isEmpty()


def test_places_among_edges(spark):
    edges = [-1.0, 0.0, 0.0, 2.5]
    rows = [None, float("nan"), -2.0, -1.0, -0.0, 2.4, 2.5, float("inf")]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v double")
    got = {r.k: r.p for r in d.select("k", reached(F.col("v"), edges).alias("p")).collect()}
    assert [got[k] for k in range(len(rows))] == [0, 4, 0, 1, 3, 3, 4, 4]
    picked = d.select("k", value_at(F.col("k") - 2, edges).alias("v")).orderBy("k").collect()
    assert [r.v for r in picked] == [None, None, *edges, None, None]


def test_plan_does_not_grow_with_the_grid(spark):
    rows = spark.createDataFrame([(0.5, True, False)], "s1 double, ok1 boolean, ok2 boolean")
    size = lambda n: len(sweep.points(rows, [[k / n for k in range(n)]])._jdf.queryExecution().toString())
    assert size(5000) < size(50) + 500
    out = sweep.points(rows, [[k / 5000 for k in range(5000)]])
    assert out.count() == 5000 and out.where("correct = 1").count() == 2501
