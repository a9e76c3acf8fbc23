"""Queries over scores and thresholds: calibration, sweeps, frontiers and redraws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermeter.functions.exprs import piecewise
from tiermeter.functions.sampling import uniform_draw
from tiermeter.operators import calibrate, montecarlo, sweep
from tiermeter.plans.adapters import FACTS_SQL, SCORED_SQL, TIERS3_SQL, decisions, facts, scored, table, tiers3
from tiermeter.plans.audit_queries import Z
from tiermeter.plans.registry import query, r9

GRID = [k / 20 for k in range(21)] + [1.0001]
GRID_SQL = "grid AS (SELECT k / 20.0e0 AS t FROM range(21) g(k) UNION ALL SELECT 1.0001e0)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return scored(table(spark, d, "events")).withColumnRenamed("fast_ok", "label")


@query(f"WITH {SCORED_SQL} SELECT round(avg((score - CAST(fast_ok AS INTEGER)) ** 2), 9) AS brier FROM scored")
def brier(spark, d):
    return calibrate.brier(pairs(spark, d)).select(r9("brier").alias("brier"))


@query(f"WITH {SCORED_SQL}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, abs(avg(CAST(fast_ok AS INTEGER)) - avg(score)) AS gap FROM scored GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 9) AS ece FROM b")
def ece(spark, d):
    return calibrate.ece(pairs(spark, d)).select(r9("ece").alias("ece"))


@query(f"""WITH {SCORED_SQL}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE fast_ok) AS k, avg(score) AS s FROM scored GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(k, 0) AS k, round(s, 9) AS mean_score, round(k::DOUBLE / n, 9) AS accuracy FROM range(10) r(bin) LEFT JOIN b USING (bin)""")
def reliability(spark, d):
    return calibrate.reliability(pairs(spark, d)).select("bin", "n", "k", r9("mean_score").alias("mean_score"), r9("accuracy").alias("accuracy"))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT score, count(*) FILTER (WHERE fast_ok) AS k, count(*) FILTER (WHERE NOT fast_ok) AS neg FROM scored GROUP BY score), r AS (SELECT *, sum(neg) OVER (ORDER BY score) AS upto FROM s)
SELECT round(sum(k * (upto - neg) + 0.5e0 * k * neg) / (sum(k) * sum(neg)), 9)::DOUBLE AS auroc FROM r""")
def auroc(spark, d):
    return calibrate.auroc(pairs(spark, d)).select(r9("auroc").alias("auroc"))


_RISK = f"""{SCORED_SQL}, s AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE NOT fast_ok) AS bad FROM scored GROUP BY score),
r AS (SELECT score, n, CAST(sum(n) OVER w AS BIGINT) AS covered, CAST(sum(bad) OVER w AS BIGINT) AS wrong, sum(n) OVER () AS total FROM s WINDOW w AS (ORDER BY score DESC))"""


@query(f"WITH {_RISK} SELECT score, covered, wrong, round(covered::DOUBLE / total, 9) AS coverage, round(wrong::DOUBLE / covered, 9) AS risk FROM r")
def risk_coverage(spark, d):
    return calibrate.risk_coverage(pairs(spark, d)).select("score", "covered", "wrong", r9("coverage").alias("coverage"), r9("risk").alias("risk"))


@query(f"WITH {_RISK} SELECT round(sum(wrong::DOUBLE / covered * n / total), 9) AS aurc FROM r")
def aurc(spark, d):
    return calibrate.aurc(pairs(spark, d)).select(r9("aurc").alias("aurc"))


@query(f"""WITH {_RISK}, t AS (SELECT count(score) AS n, count(*) - count(score) AS missing FROM facts WHERE NOT failed AND event_id % 10 <> 9),
p AS (SELECT avg((score - CAST(fast_ok AS INTEGER)) ** 2) AS brier FROM scored),
b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS m, abs(avg(CAST(fast_ok AS INTEGER)) - avg(score)) AS gap FROM scored GROUP BY 1), e AS (SELECT sum(m * gap) / sum(m) AS ece FROM b),
g AS (SELECT score, count(*) FILTER (WHERE fast_ok) AS k, count(*) FILTER (WHERE NOT fast_ok) AS neg FROM scored GROUP BY score), h AS (SELECT *, sum(neg) OVER (ORDER BY score) AS upto FROM g),
u AS (SELECT sum(k * (upto - neg) + 0.5e0 * k * neg) / (sum(k) * sum(neg)) AS auroc FROM h), a AS (SELECT sum(wrong::DOUBLE / covered * n / total) AS aurc FROM r)
SELECT n, missing, round(ece, 9) AS ece, round(brier, 9) AS brier, round(auroc, 9)::DOUBLE AS auroc, round(aurc, 9) AS aurc FROM t, p, e, u, a""")
def calibration_report(spark, d):
    """All measures of the fast tier's scores, with the graded cases that have none."""
    graded = facts(table(spark, d, "events")).where("not failed and event_id % 10 <> 9").select("score", F.col("fast_ok").alias("label"))
    m = calibrate.measures(graded)
    row = (m["n"], m["missing"], *(m[k] for k in ("ece", "brier", "auroc", "aurc")))
    return spark.createDataFrame([row], "n long, missing long, ece double, brier double, auroc double, aurc double").select("n", "missing", *[r9(k).alias(k) for k in ("ece", "brier", "auroc", "aurc")])


@query(f"WITH {_RISK}, p AS (SELECT *, least(199, floor(covered::DOUBLE / total * 200)) AS part FROM r) SELECT max(covered) AS covered, round(max_by(wrong::DOUBLE / covered, covered), 9) AS risk, min(score) AS score FROM p GROUP BY part")
def risk_curve(spark, d):
    """The risk-coverage curve by 200 points at most, as charts draw it."""
    n = F.lit(pairs(spark, d).count())
    return calibrate.curve(pairs(spark, d)).select(F.round(F.col("coverage") * n).cast("long").alias("covered"), r9("risk").alias("risk"), "score")


@query(f"""WITH {SCORED_SQL}, s AS (SELECT row_number() OVER (ORDER BY score) AS i, score, count(*) AS n, count(*) FILTER (WHERE fast_ok) AS k FROM scored GROUP BY score),
c AS (SELECT i, score, sum(n) OVER (ORDER BY i) AS cn, sum(k) OVER (ORDER BY i) AS ck, n, k FROM s),
m AS (SELECT a.i AS lo, b.i AS hi, (b.ck - a.ck + a.k)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT x.i, m.lo, min(m.mean) AS mean FROM c x JOIN m ON m.lo <= x.i AND m.hi >= x.i GROUP BY ALL)
SELECT c.score, round(max(low.mean), 9) AS fitted FROM c JOIN low USING (i) GROUP BY c.score""")
def pav_isotonic(spark, d):
    """Isotonic fit at each distinct score; the oracle is the max-min identity."""
    return calibrate.isotonic_table(pairs(spark, d)).select("score", r9("fitted").alias("fitted"))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT score + event_id % 23 * 1e-9 AS score, fast_ok FROM scored),
g AS (SELECT row_number() OVER (ORDER BY score) AS i, score, sum(count(*)) OVER (ORDER BY score) AS cn, sum(count(*) FILTER (WHERE fast_ok)) OVER (ORDER BY score) AS ck, count(*) AS n, count(*) FILTER (WHERE fast_ok) AS k FROM s GROUP BY score),
low AS (SELECT a.i AS lo, b.i AS hi, min((b.ck - a.ck + a.k)::DOUBLE / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS mean FROM g a JOIN g b ON a.i <= b.i),
top AS (SELECT hi, max(mean) AS fitted FROM low GROUP BY hi)
SELECT g.score, round(fitted, 9) AS fitted FROM g JOIN top ON g.i = top.hi""")
def pav_fine_scores(spark, d):
    """The isotonic fit of scores with nine decimals, by the max-min identity too."""
    fine = pairs(spark, d).withColumn("score", F.col("score") + F.col("event_id") % 23 * F.lit(1e-9))
    return calibrate.isotonic_table(fine).select("score", r9("fitted").alias("fitted"))


@query(f"""WITH {FACTS_SQL} SELECT event_id, round(CASE WHEN score <= 0.2e0 THEN 0.1e0 WHEN score <= 0.6e0 THEN 0.1e0 + (score - 0.2e0) * 1.25e0 WHEN score <= 0.9e0 THEN 0.6e0 + (score - 0.6e0) * 1.0e0 ELSE 0.9e0 END, 9) AS mapped FROM facts WHERE score IS NOT NULL""")
def piecewise_map(spark, d):
    f = facts(table(spark, d, "events")).where("score is not null")
    return f.select("event_id", r9(piecewise(F.col("score"), [(0.2, 0.1), (0.6, 0.6), (0.9, 0.9)])).alias("mapped"))


@query()
def calibration_cross_fit(spark, d):
    r = calibrate.cross_fitted(pairs(spark, d))
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(r.items())], "measure string, value double")


def flat(spark: SparkSession, d: str) -> DataFrame:
    """Two-tier items from an evaluation run."""
    return sweep.items(decisions(table(spark, d, "events"), "eval"), ["fast", "slow"])


_ITEMS = f"""{FACTS_SQL}, items AS (SELECT event_id, score AS s1, CASE WHEN (SELECT bool_and(event_id % 10 <> 9) FROM facts WHERE NOT failed) THEN fast_ok ELSE event_id % 61 <> 0 AND agree END AS ok1,
  CASE WHEN (SELECT bool_and(event_id % 10 <> 9) FROM facts WHERE NOT failed) THEN slow_ok ELSE TRUE END AS ok2, fast_cost AS c1, slow_cost AS c2 FROM facts WHERE NOT failed)"""


@query(f"WITH {_ITEMS} SELECT CAST(event_id AS VARCHAR) AS task_id, s1, ok1, ok2, c1 AS cost1, c2 AS cost2 FROM items")
def sweep_items(spark, d):
    return flat(spark, d).select("task_id", "s1", "ok1", "ok2", "cost1", "cost2")


_POINTS_OF = """SELECT t AS t1, count(*) AS n, count(*) FILTER (WHERE CASE WHEN s1 >= t THEN ok1 ELSE ok2 END) AS correct, count(*) FILTER (WHERE NOT coalesce(s1 >= t, FALSE)) AS escalated,
    count(*) FILTER (WHERE s1 >= t AND NOT ok1) AS skipped_wrong, CASE WHEN count(*) = count(CASE WHEN s1 >= t THEN c1 ELSE c1 + c2 END) THEN round(avg(CASE WHEN s1 >= t THEN c1 ELSE c1 + c2 END), 9) END AS cost_per_task
  FROM {rows}, grid GROUP BY t"""
#: Points have a cost only where all their items have one, so costs are compared over the items with known costs.
_POINTS = f"{_ITEMS}, {GRID_SQL}, points AS ({_POINTS_OF.format(rows='(SELECT * FROM items WHERE c1 IS NOT NULL)')})"


@query(f"WITH {_ITEMS}, {GRID_SQL} {_POINTS_OF.format(rows='items')}")
def sweep_points(spark, d):
    """Every item; a point with an unknown cost among its items has none."""
    return _shown(sweep.points(flat(spark, d), [GRID]))


@query(f"WITH {_POINTS} SELECT * FROM points")
def sweep_points_priced(spark, d):
    """The items with known costs."""
    return _shown(sweep.points(flat(spark, d).where("cost1 is not null"), [GRID]))


def _shown(p: DataFrame) -> DataFrame:
    return p.select("t1", "n", "correct", "escalated", "skipped_wrong", r9("cost_per_task").alias("cost_per_task"))


GRID1, GRID2 = [0.0, 20.0, 40.0, 60.0, 80.0, 100.01], [0.0, 25.0, 50.0, 75.0, 100.01]


@query(f"""WITH {TIERS3_SQL}, g1(t1) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in GRID1)}), g2(t2) AS (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in GRID2)})
SELECT t1, t2, count(*) AS n, count(*) FILTER (WHERE CASE WHEN s1 >= t1 THEN ok1 WHEN s2 >= t2 THEN ok2 ELSE ok3 END) AS correct,
  count(*) FILTER (WHERE s1 >= t1) AS served1, count(*) FILTER (WHERE s1 < t1 AND s2 >= t2) AS served2, count(*) FILTER (WHERE s1 < t1 AND s2 < t2) AS served3,
  CAST(sum(CASE WHEN s1 >= t1 THEN tokens WHEN s2 >= t2 THEN tokens * 6 ELSE tokens * 26 END) AS BIGINT) AS spent FROM items, g1, g2 GROUP BY t1, t2""")
def sweep_points_3tier(spark, d):
    t = tiers3(table(spark, d, "lineitem")).withColumns({"cost1": F.col("tokens"), "cost2": F.col("tokens") * 5, "cost3": F.col("tokens") * 20})
    p = sweep.points(t, [GRID1, GRID2])
    return p.select("t1", "t2", "n", "correct", "served1", "served2", "served3", F.round(F.col("cost_per_task") * F.col("n")).cast("long").alias("spent"))


#: Nearly 20,000 points, the most that a sweep takes.
WIDE = [k * 0.72 for k in range(140)] + [100.01]


@query(f"""WITH {TIERS3_SQL}, g AS (SELECT i * 0.72e0 AS t FROM range(140) r(i) UNION ALL SELECT 100.01e0),
c AS (SELECT s1, s2, count(*) AS m, count(*) FILTER (WHERE ok1) AS o1, count(*) FILTER (WHERE ok2) AS o2, count(*) FILTER (WHERE ok3) AS o3 FROM items GROUP BY s1, s2)
SELECT a.t AS t1, b.t AS t2, CAST(sum(m) AS BIGINT) AS n, CAST(sum(CASE WHEN s1 >= a.t THEN o1 WHEN s2 >= b.t THEN o2 ELSE o3 END) AS BIGINT) AS correct,
  CAST(sum(CASE WHEN s1 >= a.t THEN m ELSE 0 END) AS BIGINT) AS served1, CAST(sum(CASE WHEN s1 < a.t AND s2 >= b.t THEN m ELSE 0 END) AS BIGINT) AS served2 FROM c, g a, g b GROUP BY a.t, b.t""")
def sweep_points_wide(spark, d):
    """All pairs of 141 thresholds for two gated tiers."""
    p = sweep.points(tiers3(table(spark, d, "lineitem")), [WIDE, WIDE])
    return p.select("t1", "t2", "n", "correct", "served1", "served2")


@query(f"""WITH {SCORED_SQL}, s AS (SELECT DISTINCT score FROM scored), r AS (SELECT score, row_number() OVER (ORDER BY score) AS rank, count(*) OVER () AS n FROM s),
keep AS (SELECT DISTINCT CAST(round_even(i * ((SELECT max(n) FROM r) - 1) / 20.0e0, 0) AS BIGINT) + 1 AS rank FROM range(21) g(i))
SELECT score AS threshold FROM r JOIN keep USING (rank) UNION SELECT 0.0e0 UNION SELECT 1.0001e0""")
def sweep_default_grid(spark, d):
    g = sweep.default_grid(scored(table(spark, d, "events")), "score", 21)
    return spark.createDataFrame([(float(x),) for x in g], "threshold double")


@query(f"""WITH {_ITEMS} SELECT 'only:fast' AS name, count(*) AS n, count(*) FILTER (WHERE ok1) AS correct, CASE WHEN count(*) = count(c1) THEN round(avg(c1), 9) END AS cost_per_task FROM items
UNION ALL SELECT 'only:slow', count(*), count(*) FILTER (WHERE ok2), CASE WHEN count(*) = count(c2) THEN round(avg(c2), 9) END FROM items""")
def sweep_baselines(spark, d):
    b = sweep.baselines(flat(spark, d), ["fast", "slow"])
    return b.select("name", "n", "correct", r9("cost_per_task").alias("cost_per_task"))


@query(f"""WITH {_ITEMS}, o AS (SELECT CASE WHEN ok1 AND (NOT ok2 OR coalesce(c1, 'inf'::DOUBLE) <= c2) THEN 1 WHEN ok2 THEN 2 WHEN coalesce(c1, 'inf'::DOUBLE) <= c2 THEN 1 ELSE 2 END AS tier, ok1, ok2 FROM items)
SELECT count(*) AS n, count(*) FILTER (WHERE ok1 OR ok2) AS correct, count(*) FILTER (WHERE tier = 1) AS served1, count(*) FILTER (WHERE tier = 2) AS served2 FROM o""")
def sweep_oracle(spark, d):
    return sweep.oracle(flat(spark, d), 2).select("n", "correct", "served1", "served2")


def _table(spark: SparkSession, d: str) -> DataFrame:
    return sweep_points_priced(spark, d).withColumn("accuracy", r9(F.col("correct") / F.col("n")))


_TABLE = f"{_POINTS}, tab AS (SELECT *, round(correct::DOUBLE / n, 9) AS accuracy FROM points)"


@query(f"""WITH {_TABLE}, b AS (SELECT *, max(accuracy) OVER (ORDER BY cost_per_task, accuracy DESC, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM tab)
SELECT t1, accuracy, cost_per_task FROM b WHERE best IS NULL OR accuracy > best + 1e-12""")
def pareto_frontier(spark, d):
    return sweep.frontier(_table(spark, d), order=["t1"]).select("t1", "accuracy", "cost_per_task")


@query(f"WITH {_TABLE} SELECT t1, accuracy, cost_per_task FROM tab WHERE accuracy >= 0.9e0 - 1e-12 ORDER BY cost_per_task, accuracy DESC, escalated, t1 LIMIT 1")
def choose_max_savings(spark, d):
    return sweep.choose(_table(spark, d), "max-savings", 0.9, ["t1"]).select("t1", "accuracy", "cost_per_task")


@query(f"WITH {_TABLE} SELECT t1, accuracy, cost_per_task FROM tab ORDER BY accuracy DESC, cost_per_task, escalated, t1 LIMIT 1")
def choose_max_accuracy(spark, d):
    return sweep.choose(_table(spark, d), "max-accuracy", order=["t1"]).select("t1", "accuracy", "cost_per_task")


@query(f"WITH {_TABLE} SELECT t1, accuracy, cost_per_task FROM tab WHERE accuracy >= 0.85e0 - 1e-12 ORDER BY accuracy, cost_per_task, escalated, t1 LIMIT 1")
def choose_min_accuracy(spark, d):
    return sweep.choose(_table(spark, d), "min-accuracy", 0.85, ["t1"]).select("t1", "accuracy", "cost_per_task")


@query()
def recommendation(spark, d):
    """Threshold chosen on a part of the items and checked on the rest."""
    r = sweep.recommend(flat(spark, d).where("cost1 is not null"), [GRID])
    return spark.createDataFrame([(r["thresholds"][0], r["selection"]["accuracy"], r["holdout"]["accuracy"], r["target"])], "t1 double, selected_accuracy double, holdout_accuracy double, target double")


@query(f"""WITH {_RISK} SELECT min(score) AS threshold FROM r WHERE covered >= 20 AND wrong::DOUBLE / covered <= 0.15e0""")
def pick_threshold(spark, d):
    return sweep.pick_threshold(pairs(spark, d), 0.15)


_DOMAIN = """o AS (SELECT o_orderkey, r_name AS region, (o_orderkey * 7919 + 13) % 101 / 100.0e0 AS score, (o_orderkey * 104729 + 7) % 1000 < 400 + 550 * ((o_orderkey * 7919 + 13) % 101 / 100.0e0) - CASE WHEN r_name = 'ASIA' THEN 100 ELSE 0 END AS ok
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def domains(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    score = (F.col("o_orderkey") * 7919 + 13) % 101 / F.lit(100.0)
    ok = (F.col("o_orderkey") * 104729 + 7) % 1000 < 400 + 550 * score - F.when(F.col("r_name") == "ASIA", 100).otherwise(0)
    return o.select("o_orderkey", F.col("r_name").alias("region"), score.alias("score"), ok.alias("label"))


@query(f"""WITH {_DOMAIN}, s AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM o WHERE region = 'EUROPE' GROUP BY score),
c AS (SELECT score, sum(n) OVER w AS covered, sum(bad) OVER w AS wrong FROM s WINDOW w AS (ORDER BY score DESC)), pick AS (SELECT min(score) AS t FROM c WHERE covered >= 20 AND wrong::DOUBLE / covered <= 0.2e0)
SELECT region, t AS threshold, count(*) AS n, count(*) FILTER (WHERE score >= t) AS covered, count(*) FILTER (WHERE score >= t AND NOT ok) AS wrong FROM o, pick GROUP BY region, t""")
def drift_by_domain(spark, d):
    """A threshold picked on one region, and what it does on the others."""
    o = domains(spark, d)
    pick = sweep.pick_threshold(o.where("region = 'EUROPE'"), 0.2)
    over = F.col("score") >= F.col("threshold")
    return o.crossJoin(F.broadcast(pick)).groupBy("region", "threshold").agg(F.count("*").alias("n"), F.count_if(over).alias("covered"), F.count_if(over & ~F.col("label")).alias("wrong"))  # one threshold


@query(f"""WITH {_DOMAIN} SELECT region, CASE WHEN GROUPING(ok) = 1 THEN NULL ELSE ok END AS label, GROUPING(region)::INTEGER AS all_regions, count(*) AS n FROM o GROUP BY GROUPING SETS ((region, ok), (region), ())""")
def drift_grouping_sets(spark, d):
    """Counts by region and outcome with their totals."""
    o = domains(spark, d)
    return o.groupingSets([["region", "label"], ["region"], []], "region", "label").agg(F.grouping("region").cast("int").alias("all_regions"), F.count("*").alias("n")).select("region", "label", "all_regions", "n")


_SEEDS = 5


@query(f"""WITH {FACTS_SQL}, s AS (SELECT seed FROM range({_SEEDS}) g(seed)), drawn AS (
  SELECT seed, pi, NOT agree AS disagree FROM facts, s WHERE accepted AND CAST(('0x' || sha256(seed || '|r|' || task_id)[1:16]) AS UBIGINT)::DOUBLE / 18446744073709551616.0e0 < pi)
SELECT CAST(seed AS BIGINT) AS seed, count(*) AS n, round(sum(CAST(disagree AS INTEGER) / pi) / sum(1 / pi), 9) AS hajek FROM drawn GROUP BY seed""")
def coverage_point(spark, d):
    """The weighted estimate of each seed's audit."""
    f = facts(table(spark, d, "events")).where("accepted").select("task_id", "pi", "agree").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SEEDS - 1).cast("long"))))
    f = f.where(uniform_draw(F.col("seed").cast("string"), F.lit("r"), F.col("task_id")) < F.col("pi"))
    return f.groupBy("seed").agg(F.count("*").alias("n"), r9(F.sum((~F.col("agree")).cast("int") / F.col("pi")) / F.sum(1 / F.col("pi"))).alias("hajek"))


def census(spark: SparkSession, d: str) -> DataFrame:
    return facts(table(spark, d, "events")).where("accepted").select("task_id", "pi", (~F.col("agree")).alias("disagree"))


@query()
def coverage_full(spark, d):
    """Coverage of the finite-population interval over 5,000 redrawn audits."""
    c = census(spark, d)
    truth = c.agg(F.avg(F.col("disagree").cast("double")).alias("t")).first().t
    return montecarlo.coverage(montecarlo.intervals(montecarlo.redraw(c, 5000), 0.15), truth)


@query()
def stressed_design(spark, d):
    """Coverage on a synthetic population with a small, rarely drawn stratum."""
    strata = [(200, 0.5, 20), (40, 0.05, 4)]
    return montecarlo.coverage(montecarlo.designs(spark, strata, 2000), 24 / 240)


@query(f"""WITH {FACTS_SQL} SELECT event_type, greatest(1, CAST(ceil({Z!r}::DOUBLE * {Z!r}::DOUBLE * p * (1 - p) / (0.02e0 * 0.02e0) - 1e-9) AS BIGINT)) AS needed FROM (SELECT event_type, avg(CAST(fast_ok AS INTEGER)) AS p FROM facts GROUP BY event_type)""")
def required_n(spark, d):
    p = F.avg(F.col("fast_ok").cast("double"))
    g = facts(table(spark, d, "events")).groupBy("event_type").agg(p.alias("p"))
    return g.select("event_type", F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(Z) * F.lit(Z) * F.col("p") * (1 - F.col("p")) / F.lit(0.02 * 0.02) - 1e-9)).alias("needed"))
