"""Audit of skipped cases: classification, strata, weights and the summary."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tiermeter.functions.exprs import attempt_cost, finite, served_attempt
from tiermeter.functions.stats import Estimate, WeightedSums, audits_to_resolve, check_level, status_of, weighted_mean, weighted_proportion, wilson
from tiermeter.operators import cube
from tiermeter.sources.tables import kept

# Fixed values.
EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
MOST_STRATA, QUANTILE_GROUPS = 10, 5
SPARSE_SHARE, SPARSE_AUDITS = 0.10, 10
LOW_N_EFF, TINY_PI, TINY_AUDITS, HEAVY_SHARE = 30, 0.05, 5, 0.2
#: States of a case whose audit was drawn.
DRAWN = ("audited", "undecided", "pending", "error", "none")


def tier_order(decisions: DataFrame) -> tuple[list[str], str | None]:
    """Tiers in order and the final tier, from the distinct attempt sequences."""
    seen = decisions.select(
        F.array_distinct(F.transform("attempts", lambda a: a["tier"])).alias("tiers"),
        F.array_distinct(F.transform(F.filter("attempts", lambda a: a["threshold"].isNull()), lambda a: a["tier"])).alias("finals"),
        F.col("shadow.audit_tier").alias("audit"),
    ).distinct().collect()  # a row for each kind of path through the tiers
    return order_of(seen)


def order_of(seen: Sequence) -> tuple[list[str], str | None]:
    """Tiers in order and the final tier, from distinct (``tiers``, ``finals``, ``audit``)."""
    order: list[str] = []
    for path in sorted({tuple(r.tiers or ()) for r in seen}, key=lambda p: (-len(p), p)):
        for i, name in enumerate(path):
            if name not in order:
                order.insert(order.index(path[i - 1]) + 1 if i else 0, name)
    finals = {t for r in seen for t in r.finals or ()}
    if finals:
        final = max(finals, key=order.index)
        order.remove(final)
        return [*order, final], final
    audits = sorted({r.audit for r in seen if r.audit} - set(order))
    return (order + audits[:1], audits[0]) if audits else (order, None)


def skipped(final: str | None) -> Column:
    """Was the case served by an accepted attempt of a tier before the final one."""
    served = served_attempt(F.col("attempts"), F.col("final_tier"))
    before = F.lit(True) if final is None else F.col("final_tier") != final
    return F.coalesce(F.col("error").isNull() & served["accepted"] & served["error"].isNull() & before, F.lit(False))


def cases(decisions: DataFrame, final: str | None) -> DataFrame:
    """One row for each skipped case: score, pi, state and the three-valued outcomes."""
    d = decisions.where(skipped(final)).withColumn("served", served_attempt(F.col("attempts"), F.col("final_tier")))
    of_final = F.filter("attempts", lambda a: a["tier"] == F.lit(final))
    d = d.withColumn("last", F.get(of_final, F.size(of_final) - 1))
    shadow, served, last = F.col("shadow"), F.col("served"), F.col("last")
    is_eval = F.col("mode") == "eval"
    prob = shadow["inclusion_prob"]
    valid = F.coalesce(~F.isnan(prob) & (prob > 0) & (prob < float("inf")), F.lit(False))
    agreement = F.when(is_eval, served["agreement"]).otherwise(F.coalesce(shadow["agreement"], served["agreement"]))
    eq = agreement["equivalent"]
    status = shadow["status"]
    in_eval = F.when(agreement.isNull(), F.when(last.isNull() | last["error"].isNotNull(), "error").otherwise("none")).when(eq.isNull(), "undecided").otherwise("audited")
    in_serve = (
        F.when(shadow.isNull(), "none").when(~valid, "invalid").when(status == "done", F.when(eq.isNull(), "undecided").otherwise("audited"))
        .when(status == "pending", "pending").when(status == "error", "error").when(status == "skipped", "not-selected").otherwise("unknown")
    )
    state = F.when(is_eval, in_eval).otherwise(in_serve)
    pi = F.when(is_eval, 1.0).when(shadow.isNotNull() & valid, F.least(F.lit(1.0), prob))
    answer = F.when(is_eval, last["correct"]["equivalent"]).otherwise(shadow["attempt"]["correct"]["equivalent"])
    audited = F.col("state") == "audited"
    out = d.select(F.col("task.id").alias("task_id"), finite(served["confidence"]["score"]).alias("score"), pi.alias("pi"), state.alias("state"), eq.alias("eq"), (~served["correct"]["equivalent"]).alias("wrong"), (~answer).alias("ref_wrong"))
    return out.select("task_id", "score", "pi", "state", F.when(audited, ~F.col("eq")).alias("disagree"), "wrong", F.when(audited, F.col("ref_wrong")).alias("ref_wrong"))


def strata(found: DataFrame) -> DataFrame:
    """One row for each inclusion probability (to 6 decimals) with its stratum and that stratum's counts.

    More than ``MOST_STRATA`` probabilities are put in ``QUANTILE_GROUPS`` groups of
    about equal numbers of cases. Rounding bounds the rows that the window sees
    to a million, whatever the number of cases.
    """
    return _strata(found.where("pi is not null").groupBy(F.bround("pi", 6).alias("key")).agg(
        F.count("*").alias("members"), F.count_if(F.col("state").isin(*DRAWN)).alias("selected"), F.count_if(F.col("state") == "audited").alias("completed"), F.sum("pi").alias("expected")
    ))


def _strata(keys: DataFrame) -> DataFrame:
    everything = Window.partitionBy()
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    grouped = keys.withColumn("n_keys", F.count("*").over(everything)).withColumn("before", F.coalesce(F.sum("members").over(before), F.lit(0))).withColumn("total", F.sum("members").over(everything))
    bucket = F.least(F.lit(QUANTILE_GROUPS - 1), F.floor(F.lit(QUANTILE_GROUPS) * F.col("before") / F.col("total"))).cast("double")
    grouped = grouped.withColumn("stratum", F.when(F.col("n_keys") <= MOST_STRATA, F.col("key")).otherwise(bucket))
    own = Window.partitionBy("stratum")
    sums = [F.sum(c).over(own).alias(c) for c in ("members", "selected", "completed", "expected")]
    return grouped.select("key", "stratum", F.min("key").over(own).alias("low"), F.max("key").over(own).alias("high"), *sums)


def weighted_cases(found: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Cases with their ``stratum`` and, where audited, the weight 1 / (pi x response rate)."""
    if table is None:
        found = kept(found, "cases")  # flat rows; the nested decisions are read once
        table = strata(found)
    joined = found.join(table.select("key", "stratum", "selected", "completed"), F.bround("pi", 6) == F.col("key"), "left")
    rate = F.col("completed") / F.col("selected")
    return joined.select("task_id", "score", "pi", "state", "disagree", "wrong", "ref_wrong", "stratum", F.when(F.col("state") == "audited", 1 / (F.col("pi") * rate)).alias("weight"))


def bin_of(score: Column, edges: Sequence[float] = EDGES) -> Column:
    """The bin's number; scores beyond the ends belong to the end bins, null scores to none."""
    check_edges(edges)
    out = F.when(score < edges[1], 0)
    for i, hi in enumerate(edges[2:-1], start=1):
        out = out.when(score < hi, i)
    return F.when(score.isNotNull(), out.otherwise(len(edges) - 2) if len(edges) > 2 else F.lit(0))


def check_edges(edges: Sequence[float]) -> None:
    if len(edges) < 2 or any(not math.isfinite(e) for e in edges) or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("bin edges must be finite, strictly rising, and two at least")


def weighted_sums(outcome: Column, weight: Column) -> list[Column]:
    """Aggregates that a ``WeightedSums`` is made of; nulls in either are left out."""
    y = F.when(weight.isNotNull(), outcome)
    w = F.when(y.isNotNull(), weight)
    return [
        F.count(w).alias("n"), F.count_if(y & w.isNotNull()).alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(F.when(y, w)).alias("wy"), F.sum(F.when(y, w * w)).alias("w2y"),
        F.max(w).alias("w_max"), F.min(w).alias("w_min"), F.sum(F.when(y, w * (w - 1))).alias("vh"), F.sum(F.when(~y, w * (w - 1))).alias("vm"),
    ]


def add_sums(rows: Sequence[dict]) -> WeightedSums:
    f = lambda k: math.fsum(r[k] or 0.0 for r in rows)
    return WeightedSums(int(f("n")), int(f("k")), f("w"), f("w2"), f("wy"), f("w2y"), max((r["w_max"] for r in rows if r["w_max"] is not None), default=0.0), min((r["w_min"] for r in rows if r["w_min"] is not None), default=math.inf), f("vh"), f("vm"))


def reference_costs(decisions: DataFrame, final: str | None, reference: str | None) -> DataFrame:
    """Observed costs (``cost``, ``weight``) of the reference tier: 1 where it served, 1 / pi where it audited."""
    ok = decisions.where(F.col("error").isNull()).withColumn("skip", skipped(final))
    of_final = F.filter("attempts", lambda a: a["tier"] == F.lit(final))
    last = F.get(of_final, F.size(of_final) - 1)
    served = served_attempt(F.col("attempts"), F.col("final_tier"))
    is_eval, shadow = F.col("mode") == "eval", F.col("shadow")
    one = lambda a, cond: ok.where(cond & a.isNotNull() & a["error"].isNull()).select(attempt_cost(a).alias("cost"), F.lit(1.0).alias("weight"))
    evaluated = one(last, is_eval)
    served_by = one(served, ~is_eval & ~F.col("skip") & F.lit(reference == final) & (F.col("final_tier") == F.lit(reference)))
    prob = shadow["inclusion_prob"]
    audited = ok.where(~is_eval & F.col("skip") & (shadow["status"] == "done") & (prob > 0) & ~F.isnan(prob) & shadow["attempt"].isNotNull() & shadow["attempt"]["error"].isNull() & (shadow["audit_tier"] == F.lit(reference)))
    return evaluated.union(served_by).union(audited.select(attempt_cost(shadow["attempt"]).alias("cost"), (1 / F.least(F.lit(1.0), prob)).alias("weight")))


@dataclass(frozen=True)
class Bin:
    label: str
    lo: float
    hi: float
    n_cases: int
    n_audited: int
    n_graded: int
    disagreement: Estimate
    error: Estimate | None


@dataclass
class Summary:
    run_id: str | None
    mode: str
    n_decisions: int
    n_errors: int
    n_skipped: int
    states: dict[str, int]
    escalation_rate: Estimate
    tier_share: dict[str, int]
    tiers: list[str]
    final_tier: str | None
    reference_tier: str | None
    disagreement: Estimate | None
    disagreement_unweighted: Estimate | None
    skipped_error: Estimate | None
    audit_tier_error: Estimate | None
    served_accuracy: Estimate | None
    expected_wrong_skipped: tuple[float, float, float] | None
    expected_wrong_source: str | None
    bins: list[Bin]
    no_score_bin: Bin | None
    cost_serving: float | None
    cost_audit: float | None
    cost_per_task: float | None
    audit_overhead: float | None
    n_unknown_cost: int
    n_unknown_audit_cost: int
    est_all_slow_cost_per_task: Estimate | None
    est_savings: Estimate | None
    tolerance: float | None
    status: str
    status_metric: str | None
    audit_only_status: str | None
    audits_to_resolve: int | None
    tasks_to_resolve: int | None
    n_graded_skipped: int
    n_unrepresented: int
    sparse_strata: int
    level: float
    notes: list[str] = field(default_factory=list)

    @property
    def n_audited(self) -> int:
        return self.states.get("audited", 0)

    def to_dict(self) -> dict:
        def plain(v):
            return v.__dict__ if isinstance(v, (Estimate, Bin)) else v

        def deep(v):
            v = plain(v)
            if isinstance(v, dict):
                return {k: deep(x) for k, x in v.items()}
            return [deep(x) for x in v] if isinstance(v, (list, tuple)) else v

        return deep(self.__dict__) | {"n_audited": self.n_audited}


def cells(decisions: DataFrame, edges: Sequence[float] = EDGES) -> DataFrame:
    """The audit's additive cells, by one scan of ``decisions``; ``summarize_cells`` takes them, merged or not."""
    return cube.cells(decisions, bin_of(F.col("score"), edges))


def summarize(decisions: DataFrame, tolerance: float | None = None, level: float = 0.95, edges: Sequence[float] = EDGES) -> Summary:
    """Everything about one run's audit, from cells that one scan makes.

    All decisions must be of one run. Failed decisions are left out of skipped
    cases and tier shares but count for escalation and cost.
    """
    return summarize_cells(kept(cells(decisions, edges), "cells"), tolerance, level, edges)


def summarize_cells(cells: DataFrame, tolerance: float | None = None, level: float = 0.95, edges: Sequence[float] = EDGES) -> Summary:
    """The summary of a written table of cells, made with the same ``edges``."""
    check_level(level)
    check_edges(edges)
    if tolerance is not None and not 0 <= tolerance <= 1:
        raise ValueError("tolerance must lie in [0, 1]")
    add = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "escalated", "graded", "right", "cost_n", "audit_n")]
    heads = cells.where("kind = 'case'").groupBy("run_id", "mode", "failed", "final_tier", "tiers", "finals", F.col("audit_tier").alias("audit")).agg(*add, F.sum("cost").alias("cost"), F.sum("audit").alias("audit_cost")).collect()  # a row for each kind of path through the tiers
    head = {c: sum(r[c] for r in heads) for c in ("n", "escalated", "graded", "right", "cost_n", "audit_n")}
    n, failures, run_ids, modes = head["n"], sum(r.n for r in heads if r.failed), {r.run_id for r in heads}, {r["mode"] for r in heads}
    cost, audit_cost = (math.fsum(r[c] for r in heads if r[c] is not None) if any(r[c] is not None for r in heads) else None for c in ("cost", "audit_cost"))
    if len(run_ids) > 1:
        raise ValueError(f"decisions of several runs: {', '.join(sorted(map(str, run_ids))[:5])}")
    mode = next(iter(modes)) if len(modes) == 1 else "mixed" if modes else "n/a"
    tiers, final = order_of(heads)
    audits: dict[str, int] = {}
    share: dict[str, int] = {}
    for r in heads:
        if r.audit is not None and r["mode"] != "eval":
            audits[r.audit] = audits.get(r.audit, 0) + r.n
        if not r.failed:
            share[r.final_tier] = share.get(r.final_tier, 0) + r.n
    reference = final if mode == "eval" or not audits else max(sorted(audits), key=audits.__getitem__)

    found = cube.cases(cells, final)
    counts = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    table = _strata(found.where("pi is not null").groupBy(F.col("pi").alias("key")).agg(F.sum("n").alias("members"), counts(F.col("state").isin(*DRAWN)).alias("selected"), counts(F.col("state") == "audited").alias("completed"), F.sum("prob").alias("expected")))
    layer = ("stratum", "low", "high", "members", "selected", "completed", "expected")
    grouped = found.join(table, F.col("pi") == F.col("key"), "left")
    rate = F.col("completed") / F.col("selected")
    per = grouped.groupBy("bin", *layer).agg(
        F.sum("n").alias("cases"), counts(F.col("wrong").isNotNull()).alias("graded"), counts(F.col("wrong")).alias("wrong"), F.struct(*cube.weighted(F.col("disagree"), rate)).alias("d"),
        F.struct(*cube.weighted(F.col("ref_wrong"), rate)).alias("r"), *[counts(F.col("state") == s).alias(f"s_{s}") for s in (*DRAWN, "not-selected", "invalid", "unknown")], F.min(1 / F.col("w_max")).alias("least_pi"), counts(F.col("pi").isNotNull()).alias("with_pi"),
    )
    rows = [r.asDict(recursive=True) for r in per.collect()]  # bins x strata
    layers = [Row(**dict(zip(layer, x, strict=True))) for x in sorted({tuple(r[c] for c in layer) for r in rows if r["stratum"] is not None})]
    states = {s: k for s in (*DRAWN, "not-selected", "invalid", "unknown") if (k := sum(r[f"s_{s}"] for r in rows))}
    n_skipped = sum(r["cases"] for r in rows)
    n_audited, graded, bad = states.get("audited", 0), sum(r["graded"] for r in rows), sum(r["wrong"] for r in rows)
    sums = add_sums([r["d"] for r in rows])
    refs = add_sums([r["r"] for r in rows])
    disagreement = weighted_proportion(sums, level, finite=True) if n_audited else None
    skipped_error = wilson(bad, graded, level) if graded else None

    notes = []
    with_pi = sum(r["with_pi"] for r in rows)
    lost = sum(s.members for s in layers if not s.completed)
    sparse = [s for s in layers if len(layers) > 1 and s.members / with_pi >= SPARSE_SHARE and s.completed < SPARSE_AUDITS]
    if failures:
        notes.append(f"{failures} decisions failed and are left out of skipped cases and tier shares.")
    if not n:
        notes.append("There are no decisions.")
    elif not n_skipped:
        notes.append("There are no skipped cases.")
    for s, what in (("pending", "pending"), ("error", "in error"), ("undecided", "undecided")):
        if states.get(s):
            notes.append(f"{states[s]} audits {what} count as nonresponse; the other audits of their stratum stand for them.")
    for s, what in (("none", "no audit record"), ("invalid", "an invalid inclusion probability"), ("unknown", "an unknown audit status")):
        if states.get(s):
            notes.append(f"{states[s]} skipped cases have {what} and aren't represented.")
    if disagreement and (disagreement.n_eff or 0) < LOW_N_EFF:
        notes.append(f"The effective sample size is only {disagreement.n_eff:.1f}.")
    for s in layers:
        if s.low < TINY_PI and s.completed < TINY_AUDITS:
            notes.append(f"{s.members} skipped cases drawn at {s.low:g} have only {s.completed} audits.")
    if lost and n_audited:
        notes.append(f"{lost} skipped cases are in strata without a completed audit.")
    for s in sparse:
        notes.append(f"The stratum at {s.low:g} holds {s.members / with_pi:.0%} of the skipped cases with {s.completed} audits; the status can't be ok.")
    if sums.n > 1 and sums.w_max / sums.w > HEAVY_SHARE:
        notes.append(f"One audit carries {sums.w_max / sums.w:.0%} of the weight.")

    metric_name, metric = ("skipped_error", skipped_error) if n_skipped and graded == n_skipped else ("disagreement", disagreement)
    status = status_of(metric, tolerance, block_ok=metric_name == "disagreement" and bool(sparse))
    more = tasks = None
    if status == "inconclusive":
        extra = audits_to_resolve(metric, tolerance, level, sums if metric_name == "disagreement" else None)
        if extra is not None and metric.n:
            tasks = math.ceil(extra * n_skipped / metric.n - 1e-9)
        census = with_pi == n_skipped and all(r["least_pi"] is None or r["least_pi"] >= 1 for r in rows)
        if metric_name == "disagreement" and not census:
            more = extra
    rate, source = (skipped_error, "skipped_error") if skipped_error else (disagreement, "disagreement")
    expected = (rate.value * n_skipped, rate.lo * n_skipped, rate.hi * n_skipped) if rate and rate.value is not None else None

    def one_bin(label: str, lo: float, hi: float, own: list[dict]) -> Bin:
        d, g = add_sums([r["d"] for r in own]), sum(r["graded"] for r in own)
        return Bin(label, lo, hi, sum(r["cases"] for r in own), d.n, g, weighted_proportion(d, level, finite=True), wilson(sum(r["wrong"] for r in own), g, level) if g else None)

    bins = [one_bin(f"[{lo:.2f}, {hi:.2f}{']' if i == len(edges) - 2 else ')'}", lo, hi, [r for r in rows if r["bin"] == i]) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    unscored = [r for r in rows if r["bin"] is None]

    per_task = cost / head["cost_n"] if head["cost_n"] else None
    s = cube.reference_cost(cells, final, reference)
    slow = weighted_mean(s["n"], s["w"], s["w2"], s["wx"], s["w2x"], s["w2x2"], s["equal"], s["sd"], level)
    if slow and mode != "eval" and (states.get("none") or states.get("invalid")):
        slow = None
        notes.append("Some skipped cases have no usable inclusion probability, so the reference tier's cost can't be carried over to the run.")
    savings = None
    if slow and slow.value and slow.value > 0 and per_task is not None:
        save = lambda a: None if a is None or a <= 0 else 1 - per_task / a
        savings = replace(slow, value=save(slow.value), lo=save(slow.lo), hi=save(slow.hi), method="ratio-approx")
    return Summary(
        run_id=next(iter(run_ids), None), mode=mode, n_decisions=n, n_errors=failures, n_skipped=n_skipped, states=states, escalation_rate=wilson(head["escalated"], n, level), tier_share=share,
        tiers=tiers, final_tier=final, reference_tier=reference, disagreement=disagreement, disagreement_unweighted=wilson(sums.k, sums.n, level) if n_audited else None, skipped_error=skipped_error,
        audit_tier_error=weighted_proportion(refs, level, finite=refs.n == n_audited) if refs.n else None, served_accuracy=wilson(head["right"], head["graded"], level) if head["graded"] else None,
        expected_wrong_skipped=expected, expected_wrong_source=source if expected else None, bins=bins, no_score_bin=one_bin("no score", math.nan, math.nan, unscored) if unscored else None,
        cost_serving=cost, cost_audit=audit_cost, cost_per_task=per_task, audit_overhead=audit_cost / cost if audit_cost is not None and cost else None, n_unknown_cost=n - head["cost_n"], n_unknown_audit_cost=n - head["audit_n"],
        est_all_slow_cost_per_task=slow, est_savings=savings, tolerance=tolerance, status=status, status_metric=metric_name if status != "no-data" else None,
        audit_only_status=status_of(disagreement, tolerance, bool(sparse)) if metric_name == "skipped_error" and tolerance is not None and disagreement else None,
        audits_to_resolve=more, tasks_to_resolve=tasks, n_graded_skipped=graded, n_unrepresented=lost, sparse_strata=len(sparse), level=level, notes=notes,
    )
