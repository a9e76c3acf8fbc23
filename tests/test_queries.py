"""Every query of the catalog against its SQL at the smallest scale."""

import math

import pytest

from conftest import SF
from tiermeter.plans import all_oracles, all_queries

ROWS_ONLY = sorted(set(all_queries()) - set(all_oracles()))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_as_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert all_queries()[name](spark, SF).collect()


def test_exact_bounds_of_the_groups(spark):
    """Clopper-Pearson bounds leave half the error on each side, by the binomial sum itself."""

    def tail(k, n, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    for r in all_queries()["clopper_pearson_by_group"](spark, SF).collect():
        assert 0 < r.k < r.n
        assert tail(r.k, r.n, r.lo) == pytest.approx(0.025, rel=1e-4) and 1 - tail(r.k + 1, r.n, r.hi) == pytest.approx(0.025, rel=1e-4)


def test_arithmetic_answers_fold(spark):
    rows = all_queries()["arithmetic_tasks"](spark, SF).collect()
    assert len({r.id for r in rows}) == 200 and all(r.folds for r in rows)


def test_normal_and_bootstrap_bounds_agree(spark):
    e = all_queries()["bootstrap_score"](spark, SF).first()
    assert e.lo < e.value < e.hi and e.hi - e.lo < 0.1


def test_streamed_run_decides_each_task_once(spark):
    r = all_queries()["streaming_resume"](spark, SF).first()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert r.tasks == r.decisions <= n and r.escalated < r.decisions


def test_bootstrap_intervals_hold_the_values_of_sql(spark, duck):
    got = {r.measure: r for r in all_queries()["bootstrap_intervals"](spark, SF).collect()}
    want = duck.execute(f"SELECT hajek FROM ({all_oracles()['audit_hajek']})").fetchone()[0], duck.execute(f"SELECT auroc FROM ({all_oracles()['auroc']})").fetchone()[0]
    for measure, value in zip(("disagreement", "auroc"), want, strict=True):
        r = got[measure]
        assert r.value == pytest.approx(float(value), abs=1e-8) and r.lo < r.value < r.hi < r.lo + 0.6
