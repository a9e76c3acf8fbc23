"""Queries over decisions: audit states, strata, estimates, costs and tier shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermeter.functions.exprs import accepts, attempt_cost, last_good_attempt, served_attempt, sum_or_null, unusable
from tiermeter.functions.stats import audits_to_resolve, clopper_pearson, mcnemar_p, paired_difference, weighted_proportion, z_for
from tiermeter.operators import audit, bootstrap, cube
from tiermeter.operators.montecarlo import bootstrap_mean
from tiermeter.plans.adapters import CASES_SQL, FACTS_SQL, decisions, facts, table
from tiermeter.plans.registry import query, r9
from tiermeter.sources.tables import kept

Z = z_for(0.95)


def served(spark: SparkSession, d: str, mode: str = "serve") -> DataFrame:
    return decisions(table(spark, d, "events"), mode)


def found(spark: SparkSession, d: str) -> DataFrame:
    return audit.cases(served(spark, d), "slow")


def wilson_columns(k: str, n: str) -> list:
    """Wilson bounds in Catalyst, for many groups at once."""
    p, size, z = F.col(k) / F.col(n), F.col(n), F.lit(Z)
    den = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / den
    half = z / den * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    lo = F.when(F.col(k) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    hi = F.when(F.col(k) == F.col(n), 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return [F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi")]


def wilson_sql(k: str, n: str) -> str:
    z, p = f"{Z!r}::DOUBLE", f"({k}::DOUBLE / {n})"
    den = f"(1 + {z} * {z} / {n})"
    centre, half = f"(({p} + {z} * {z} / (2 * {n})) / {den})", f"({z} / {den} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n})))"
    return f"round(CASE WHEN {k} = 0 THEN 0 ELSE greatest(0, {centre} - {half}) END, 9)::DOUBLE AS lo, round(CASE WHEN {k} = {n} THEN 1 ELSE least(1, {centre} + {half}) END, 9)::DOUBLE AS hi"


@query(f"""WITH {CASES_SQL}
SELECT (SELECT count(*) FROM cases) AS skipped, count(*) AS audited, round(sum(w * CAST(disagree AS INTEGER)) / sum(w), 9) AS hajek,
  round((SELECT avg(CAST(disagree AS INTEGER)) FROM cases), 9) AS census, round((SELECT avg(CAST(wrong AS INTEGER)) FROM cases), 9) AS graded_error FROM weighted""")
def audit_hajek(spark, d):
    """Weighted disagreement of the audited cases, beside the census that an evaluation would give."""
    base = found(spark, d)
    w = audit.weighted_cases(base)
    y = F.col("disagree").cast("double")
    est = w.agg(F.count("*").alias("skipped"), F.count_if(F.col("state") == "audited").alias("audited"), r9(F.sum(F.col("weight") * y) / F.sum("weight")).alias("hajek"), r9(F.avg(F.col("wrong").cast("double"))).alias("graded_error"))
    census = facts(table(spark, d, "events")).where("accepted").agg(r9(F.avg((~F.col("agree")).cast("double"))).alias("census"))
    return est.crossJoin(F.broadcast(census))  # one row each


@query(f"WITH {CASES_SQL} SELECT state, count(*) AS n FROM cases GROUP BY state")
def audit_states(spark, d):
    return found(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {CASES_SQL} SELECT state, count(*) AS n, count(*) FILTER (WHERE state = 'audited') AS audited, count(*) FILTER (WHERE state = 'audited' AND disagree) AS differ FROM cases GROUP BY state")
def audit_cells(spark, d):
    """States and outcomes from the merged cells of two halves of a run."""
    run = kept(served(spark, d), "decisions")  # as a log has them
    halves = [kept(audit.cells(run.where(F.col("seq") % 2 == k)), "cells") for k in (0, 1)]
    each = cube.cases(kept(cube.merged(*halves), "cells"), "slow")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("state").agg(F.sum("n").alias("n"), n(F.col("disagree").isNotNull()).alias("audited"), n(F.col("disagree")).alias("differ"))


@query(f"WITH {CASES_SQL} SELECT pi, members, selected, completed FROM strata")
def audit_strata(spark, d):
    return audit.strata(found(spark, d)).select(F.col("key").alias("pi"), "members", "selected", "completed")


@query(f"WITH {CASES_SQL} SELECT pi, count(*) AS n, round(min(w), 9) AS weight FROM weighted GROUP BY pi")
def audit_response_weights(spark, d):
    return audit.weighted_cases(found(spark, d)).where("weight is not null").groupBy("pi").agg(F.count("*").alias("n"), r9(F.min("weight")).alias("weight"))


_BIN = "CASE WHEN score IS NULL THEN NULL WHEN score < 0.5e0 THEN 0 WHEN score < 0.7e0 THEN 1 WHEN score < 0.8e0 THEN 2 WHEN score < 0.9e0 THEN 3 WHEN score < 0.95e0 THEN 4 ELSE 5 END"


@query(f"""WITH {CASES_SQL}, b AS (SELECT c.*, {_BIN} AS bin, w.w FROM cases c LEFT JOIN (SELECT task_id, w FROM weighted) w USING (task_id))
SELECT bin, count(*) AS cases, count(w) AS audited, count(wrong) AS graded, count(*) FILTER (WHERE wrong) AS wrong,
  round(sum(CASE WHEN disagree THEN w END) / sum(w), 9) AS disagreement FROM b GROUP BY bin""")
def audit_bins(spark, d):
    w = audit.weighted_cases(found(spark, d)).withColumn("bin", audit.bin_of(F.col("score")))
    y = F.when(F.col("disagree"), F.col("weight"))
    return w.groupBy("bin").agg(F.count("*").alias("cases"), F.count("weight").alias("audited"), F.count("wrong").alias("graded"), F.count_if("wrong").alias("wrong"), r9(F.try_divide(F.sum(y), F.sum("weight"))).alias("disagreement"))


@query(f"WITH {FACTS_SQL} SELECT CASE WHEN accepted THEN 'fast' ELSE 'slow' END AS tier, count(*) AS n FROM facts WHERE NOT failed GROUP BY ALL")
def audit_tier_share(spark, d):
    return served(spark, d).where("error is null").groupBy(F.col("final_tier").alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS_SQL}, c AS (SELECT count(*) FILTER (WHERE NOT accepted) AS k, count(*) AS n FROM facts) SELECT k, n, {wilson_sql('k', 'n')} FROM c")
def audit_escalation(spark, d):
    return served(spark, d).agg(F.count_if("escalated").alias("k"), F.count("*").alias("n")).select("k", "n", *wilson_columns("k", "n"))


_COSTS = """costs AS (SELECT *, CASE WHEN accepted THEN fast_cost ELSE fast_cost + CASE WHEN failed THEN 0 ELSE slow_cost END END AS serving,
  CASE WHEN accepted AND event_id % 67 <> 0 AND u < pi AND event_id % 53 <> 0 AND event_id % 59 <> 0 THEN slow_cost ELSE 0 END AS audit FROM facts)"""


@query(f"""WITH {FACTS_SQL}, {_COSTS}
SELECT round(sum(serving), 9) AS cost_serving, round(sum(audit), 9) AS cost_audit, count(*) - count(serving) AS unknown_cost, round(sum(serving) / count(serving), 9) AS cost_per_task,
  round(sum(audit) / sum(serving), 9) AS overhead FROM costs""")
def audit_costs(spark, d):
    return served(spark, d).agg(r9(F.sum("cost_usd")).alias("cost_serving"), r9(F.sum("audit_cost_usd")).alias("cost_audit"), (F.count("*") - F.count("cost_usd")).alias("unknown_cost"), r9(F.avg("cost_usd")).alias("cost_per_task"), r9(F.sum("audit_cost_usd") / F.sum("cost_usd")).alias("overhead"))


@query(f"""WITH {FACTS_SQL}, o AS (
  SELECT slow_cost AS c, 1.0e0 AS w FROM facts WHERE NOT accepted AND NOT failed
  UNION ALL SELECT slow_cost, 1.0e0 / pi FROM facts WHERE accepted AND event_id % 67 <> 0 AND event_id % 71 <> 0 AND u < pi AND event_id % 53 <> 0 AND event_id % 59 <> 0)
SELECT count(*) AS n, round(sum(w), 6) AS weight, round(sum(w * c) / sum(w), 9) AS always_final FROM o""")
def audit_always_final(spark, d):
    """Mean cost of the final tier over all tasks: served ones count once, audited ones 1 / pi times."""
    c = audit.reference_costs(served(spark, d), "slow", "slow")
    return c.agg(F.count("cost").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), r9(F.sum(F.col("cost") * F.col("weight")) / F.sum("weight")).alias("always_final"))


@query(f"""WITH {CASES_SQL}, c AS (SELECT count(*) FILTER (WHERE wrong) AS k, count(wrong) AS n FROM cases) SELECT k, n, {wilson_sql('k', 'n')} FROM c""")
def audit_skipped_error(spark, d):
    return found(spark, d).agg(F.count_if("wrong").alias("k"), F.count("wrong").alias("n")).select("k", "n", *wilson_columns("k", "n"))


@query(f"""WITH {FACTS_SQL}, c AS (SELECT count(*) FILTER (WHERE CASE WHEN accepted OR failed THEN fast_ok ELSE slow_ok END) AS k, count(*) AS n FROM facts WHERE event_id % 10 <> 9) SELECT k, n, {wilson_sql('k', 'n')} FROM c""")
def served_accuracy(spark, d):
    eq = F.col("correct.equivalent")
    return served(spark, d).agg(F.count_if(eq).alias("k"), F.count(eq).alias("n")).select("k", "n", *wilson_columns("k", "n"))


@query(f"""WITH {CASES_SQL} SELECT count(*) AS n, round(sum(CASE WHEN NOT slow_ok THEN w ELSE 0 END) / sum(w), 9) AS audit_tier_error FROM weighted WHERE event_id % 10 <> 9""")
def audit_tier_error(spark, d):
    w = audit.weighted_cases(found(spark, d)).where("weight is not null and ref_wrong is not null")
    return w.agg(F.count("*").alias("n"), r9(F.sum(F.when(F.col("ref_wrong"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("audit_tier_error"))


@query(f"""WITH {FACTS_SQL} SELECT count(*) FILTER (WHERE NOT fast_ok) AS wrong, count(*) FILTER (WHERE NOT agree) AS disagree, count(*) FILTER (WHERE NOT fast_ok AND agree) AS shared,
  count(*) FILTER (WHERE NOT fast_ok AND NOT agree AND slow_ok) AS caught, count(*) FILTER (WHERE NOT fast_ok AND NOT agree AND NOT slow_ok) AS both_wrong_differ,
  count(*) FILTER (WHERE fast_ok AND NOT agree) AS false_alarm FROM facts WHERE accepted AND event_id % 61 <> 0 AND event_id % 10 <> 9""")
def audit_truth_split(spark, d):
    """What disagreement with the final tier sees of the cheap tier's errors, on an evaluation run."""
    c = audit.cases(served(spark, d, "eval"), "slow").where("state = 'audited' and wrong is not null")
    w, x, r = F.col("wrong"), F.col("disagree"), F.col("ref_wrong")
    return c.agg(F.count_if(w).alias("wrong"), F.count_if(x).alias("disagree"), F.count_if(w & ~x).alias("shared"), F.count_if(w & x & ~r).alias("caught"), F.count_if(w & x & r).alias("both_wrong_differ"), F.count_if(~w & x).alias("false_alarm"))


@query(f"""WITH {CASES_SQL}, t AS (SELECT *, members::DOUBLE / sum(members) OVER () AS share, count(*) OVER () AS n FROM strata)
SELECT pi, members, completed, n > 1 AND share >= 0.10e0 AND completed < 10 AS sparse FROM t""")
def audit_sparse(spark, d):
    s = audit.strata(found(spark, d)).select("stratum", "low", "members", "completed").distinct()
    total = s.agg(F.sum("members").alias("total"), F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(total)).select(F.col("low").alias("pi"), "members", "completed", ((F.col("n") > 1) & (F.col("members") / F.col("total") >= audit.SPARSE_SHARE) & (F.col("completed") < audit.SPARSE_AUDITS)).alias("sparse"))  # one row of totals


@query(f"""WITH {CASES_SQL} SELECT count(*) FILTER (WHERE completed = 0) AS strata, coalesce(sum(members) FILTER (WHERE completed = 0), 0)::BIGINT AS cases FROM strata""")
def audit_unrepresented(spark, d):
    return audit.strata(found(spark, d)).agg(F.count_if(F.col("completed") == 0).alias("strata"), F.coalesce(F.sum(F.when(F.col("completed") == 0, F.col("members"))), F.lit(0)).cast("long").alias("cases"))


@query(f"""WITH {FACTS_SQL}, g AS (SELECT event_type, count(*) FILTER (WHERE NOT agree) AS k, count(*) AS n FROM facts WHERE accepted GROUP BY event_type), b AS (SELECT *, {wilson_sql('k', 'n')} FROM g)
SELECT event_type, k, n, lo, hi, CASE WHEN lo > 0.15e0 THEN 'breach' WHEN hi <= 0.15e0 THEN 'ok' ELSE 'inconclusive' END AS status FROM b""")
def status_rule_wilson(spark, d):
    g = facts(table(spark, d, "events")).where("accepted").groupBy("event_type").agg(F.count_if(~F.col("agree")).alias("k"), F.count("*").alias("n"))
    b = g.select("event_type", "k", "n", *wilson_columns("k", "n"))
    return b.withColumn("status", F.when(F.col("lo") > 0.15, "breach").when(F.col("hi") <= 0.15, "ok").otherwise("inconclusive"))


@query(f"""WITH {FACTS_SQL}, g AS (SELECT event_type, count(*) FILTER (WHERE fast_ok) AS k, count(*) AS n FROM facts GROUP BY event_type) SELECT event_type, k, n, {wilson_sql('k', 'n')} FROM g""")
def wilson_by_group(spark, d):
    g = facts(table(spark, d, "events")).groupBy("event_type").agg(F.count_if("fast_ok").alias("k"), F.count("*").alias("n"))
    return g.select("event_type", "k", "n", *wilson_columns("k", "n"))


@query(f"""SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(avg(value) - {Z!r}::DOUBLE * stddev_samp(value) / sqrt(count(*)), 9) AS lo, round(avg(value) + {Z!r}::DOUBLE * stddev_samp(value) / sqrt(count(*)), 9) AS hi FROM events GROUP BY event_type""")
def mean_ci_by_group(spark, d):
    half = F.lit(Z) * F.stddev_samp("value") / F.sqrt(F.count("*"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r9(F.avg("value")).alias("mean"), r9(F.avg("value") - half).alias("lo"), r9(F.avg("value") + half).alias("hi"))


@query(f"""WITH {CASES_SQL}, x AS (SELECT w, slow_cost * 1000 AS x FROM weighted), m AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS m, sum(w * w) AS sw2 FROM x)
SELECT n, round(m, 6) AS mean, round(sw * sw / sw2, 6) AS n_eff, round((SELECT sum(w * w * (x - m) * (x - m)) FROM x) / (sw * sw) * n / (n - 1), 6) AS variance FROM m""")
def weighted_mean(spark, d):
    """Hájek mean of the audit tier's cost with its linearized variance, in one pass."""
    w = audit.weighted_cases(found(spark, d)).where("weight is not null").select("task_id", "weight")
    x = w.join(facts(table(spark, d, "events")).select("task_id", (F.col("slow_cost") * 1000).alias("x")), "task_id")
    a, c = F.col("weight"), F.col("x")
    s = x.agg(F.count("*").alias("n"), F.sum(a).alias("sw"), F.sum(a * c).alias("wx"), F.sum(a * a).alias("w2"), F.sum(a * a * c).alias("w2x"), F.sum(a * a * c * c).alias("w2x2")).withColumn("m", F.col("wx") / F.col("sw"))
    m, n = F.col("m"), F.col("n")
    return s.select("n", F.round("m", 6).alias("mean"), F.round(F.col("sw") ** 2 / F.col("w2"), 6).alias("n_eff"), F.round((F.col("w2x2") - 2 * m * F.col("w2x") + m * m * F.col("w2")) / F.col("sw") ** 2 * n / (n - 1), 6).alias("variance"))


@query(f"""WITH {FACTS_SQL} SELECT task_id, accepted OR failed AS by_fast, NOT accepted AS escalated, CASE WHEN accepted OR failed THEN fast_ok ELSE slow_ok END AS answer_ok, failed FROM facts""")
def route_decisions(spark, d):
    """The serving attempt of each decision: first accepted, or the last good one where the final tier failed."""
    x = served(spark, d)
    a = F.when(F.col("error").isNotNull(), last_good_attempt(F.col("attempts"))).otherwise(served_attempt(F.col("attempts"), F.col("final_tier")))
    return x.select(F.col("task.id").alias("task_id"), (a["tier"] == "fast").alias("by_fast"), "escalated", (a["answer"] == "right").alias("answer_ok"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {FACTS_SQL} SELECT event_type, count(*) FILTER (WHERE coalesce(score >= 0.55e0, FALSE)) AS accepted, count(*) FILTER (WHERE score IS NULL) AS unscored FROM facts GROUP BY event_type""")
def acceptance(spark, d):
    f = facts(table(spark, d, "events"))
    return f.groupBy("event_type").agg(F.count_if(accepts(F.col("score"), F.lit(0.55))).alias("accepted"), F.count_if(F.col("score").isNull()).alias("unscored"))


@query("""SELECT role, count(*) FILTER (WHERE trim(text) = '' OR turn % 7 = 0) AS unusable, count(*) AS n FROM conversations GROUP BY role""")
def unusable_replies(spark, d):
    c = table(spark, d, "conversations")
    stop = F.when(F.col("turn") % 7 == 0, "max_tokens").otherwise("end_turn")
    return c.groupBy("role").agg(F.count_if(unusable(stop, F.col("text"))).alias("unusable"), F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT 1 + CAST(NOT accepted AS INTEGER) AS n_attempts, CASE WHEN accepted THEN 'fast' ELSE 'fast,slow' END AS path, count(*) AS n FROM facts GROUP BY ALL""")
def attempts_unnested(spark, d):
    """Attempts taken apart in order and put together as a path."""
    a = served(spark, d).select("seq", F.posexplode("attempts").alias("pos", "a")).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("a.tier").alias("tier")))).alias("t"))
    return a.groupBy(F.size("t").alias("n_attempts"), F.array_join(F.transform("t", lambda x: x["tier"]), ",").alias("path")).agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL}, c AS (SELECT event_type, CASE WHEN accepted THEN fast_cost ELSE fast_cost + slow_cost END AS c FROM facts WHERE NOT failed)
SELECT event_type, count(*) AS n, count(c) AS known, CASE WHEN count(*) = count(c) THEN round(sum(c), 9) END AS strict_total, round(sum(c), 9) AS known_total FROM c GROUP BY event_type""")
def contagious_cost(spark, d):
    """A sum that is unknown if a part is, beside the sum of known parts."""
    x = served(spark, d).where("error is null").select(F.get_json_object("task.meta", "$.event_type").alias("event_type"), sum_or_null(F.transform("attempts", attempt_cost)).alias("c"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count("c").alias("known"), F.when(F.count("*") == F.count("c"), r9(F.sum("c"))).alias("strict_total"), r9(F.sum("c")).alias("known_total"))


@query(f"""WITH {FACTS_SQL}, {_COSTS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed) AS completed, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT accepted) AS escalated,
  count(*) FILTER (WHERE accepted AND event_id % 67 <> 0 AND u < pi AND event_id % 53 <> 0 AND event_id % 59 <> 0) AS audited, count(*) FILTER (WHERE serving IS NULL) AS unknown_cost FROM costs""")
def run_counters(spark, d):
    """The counters that a run reports when it ends."""
    e = F.col("error")
    return served(spark, d).agg(F.count("*").alias("total"), F.count_if(e.isNull()).alias("completed"), F.count_if(e.isNotNull()).alias("failed"), F.count_if("escalated").alias("escalated"), F.count_if(F.coalesce(F.col("shadow.status") == "done", F.lit(False))).alias("audited"), F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost"))


@query(f"""WITH {FACTS_SQL}, {_COSTS} SELECT round(avg(CASE WHEN failed THEN NULL ELSE serving END), 9) AS serve_cost, round(avg(CASE WHEN failed THEN NULL ELSE slow_cost END), 9) AS always_slow,
  round(1 - avg(CASE WHEN failed THEN NULL ELSE serving END) / avg(CASE WHEN failed THEN NULL ELSE slow_cost END), 9) AS savings FROM costs""")
def cost_comparison(spark, d):
    """Serving cost of a served run beside the final tier's cost in an evaluation of the same tasks."""
    s = served(spark, d).where("error is null").select(F.col("task.id").alias("id"), "cost_usd")
    last = F.element_at("attempts", -1)
    e = served(spark, d, "eval").where("error is null").select(F.col("task.id").alias("id"), attempt_cost(last).alias("slow"))
    return s.join(e, "id").agg(r9(F.avg("cost_usd")).alias("serve_cost"), r9(F.avg("slow")).alias("always_slow"), r9(1 - F.avg("cost_usd") / F.avg("slow")).alias("savings"))


@query()
def audit_summary(spark, d):
    """The whole summary of a run, as one row of its main figures."""
    s = audit.summarize(kept(served(spark, d), "decisions"), tolerance=0.15)
    e = s.disagreement
    row = (s.mode, s.n_decisions, s.n_errors, s.n_skipped, s.n_audited, e.value, e.lo, e.hi, e.n_eff, s.status, s.status_metric, s.audits_to_resolve, s.tasks_to_resolve, s.est_savings.value if s.est_savings else None, len(s.notes))
    return spark.createDataFrame([row], "mode string, n_decisions long, n_errors long, n_skipped long, n_audited long, disagreement double, lo double, hi double, n_eff double, status string, status_metric string, audits_to_resolve long, tasks_to_resolve long, est_savings double, n_notes long")


@query()
def audit_interval_fpc(spark, d):
    """Finite-population intervals for each kind of event."""
    f = facts(table(spark, d, "events")).where("accepted").select("task_id", "event_type")
    w = audit.weighted_cases(found(spark, d)).join(f, "task_id").groupBy("event_type").agg(*audit.weighted_sums(F.col("disagree"), F.col("weight")))
    rows = [(r.event_type, e.value, e.lo, e.hi, e.n_eff) for r in w.collect() if (e := weighted_proportion(audit.add_sums([r.asDict()]), finite=True))]  # a row for each kind
    return spark.createDataFrame(rows, "event_type string, value double, lo double, hi double, n_eff double")


@query()
def clopper_pearson_by_group(spark, d):
    g = facts(table(spark, d, "events")).groupBy("event_type").agg(F.count_if("fast_ok").alias("k"), F.count("*").alias("n")).collect()
    rows = [(r.event_type, r.k, r.n, e.lo, e.hi) for r in g if (e := clopper_pearson(r.k, r.n))]
    return spark.createDataFrame(rows, "event_type string, k long, n long, lo double, hi double")


@query()
def paired_diff(spark, d):
    """Accuracy of the fast against the slow tier on the same tasks, from three counts."""
    f = facts(table(spark, d, "events"))
    r = f.agg(F.count_if(F.col("slow_ok") & ~F.col("fast_ok")).alias("worse"), F.count_if(F.col("slow_ok") == F.col("fast_ok")).alias("same"), F.count_if(~F.col("slow_ok") & F.col("fast_ok")).alias("better")).first()
    e = paired_difference(r.worse, r.same, r.better)
    return spark.createDataFrame([(r.worse, r.same, r.better, e.value, e.lo, e.hi, mcnemar_p(r.worse, r.better))], "worse long, same long, better long, difference double, lo double, hi double, mcnemar_p double")


@query()
def audits_to_resolve_by_group(spark, d):
    g = facts(table(spark, d, "events")).where("accepted").groupBy("event_type").agg(F.count_if(~F.col("agree")).alias("k"), F.count("*").alias("n")).collect()
    rows = [(r.event_type, r.k, r.n, audits_to_resolve(clopper_pearson(r.k, r.n), 0.2)) for r in g]
    return spark.createDataFrame(rows, "event_type string, k long, n long, more long")


@query()
def bootstrap_score(spark, d):
    """The mean score with its bootstrap interval."""
    e = bootstrap_mean(facts(table(spark, d, "events")), "score")
    return spark.createDataFrame([(e.value, e.lo, e.hi, e.n)], "value double, lo double, hi double, n long")


@query()
def bootstrap_intervals(spark, d):
    """Bootstrap intervals of the scores' AUROC and of the audit's weighted disagreement; tests hold them against plain numpy."""
    graded = facts(table(spark, d, "events")).where("not failed and event_id % 10 <> 9 and score is not null").select("event_id", "score", F.col("fast_ok").alias("label"))
    weighted = audit.weighted_cases(found(spark, d)).select("task_id", F.col("disagree"), "weight")
    both = {"auroc": bootstrap.auroc(graded, "event_id", reps=500), "disagreement": bootstrap.ratio(weighted, "task_id", F.col("disagree"), F.col("weight"), reps=500)}
    return spark.createDataFrame([(k, e.value, e.lo, e.hi, e.n) for k, e in both.items()], "measure string, value double, lo double, hi double, n long")
