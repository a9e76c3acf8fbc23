"""Routing tasks through tiers of answerers.

Each tier is a stage: the tasks that no earlier tier was accepted for go to it,
and its answers are written before anything reads them, since calls cost money
and Spark may evaluate a plan more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tiermeter.functions.exprs import accepts, attempt_cost, finite, last_good_attempt, sum_or_null, unusable
from tiermeter.functions.sampling import inclusion_prob, selected
from tiermeter.operators.simulate import Answerer, answers
from tiermeter.schema import ATTEMPT, COMPLETION, CONFIDENCE, DECISION, JUDGEMENT, SHADOW, TASK, struct_of
from tiermeter.sources.tables import kept

#: Answers a DataFrame of tasks: adds text, answer, score, cost_usd, latency_s, and error where a call failed.
Backend = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tier:
    name: str
    backend: Backend | Answerer
    threshold: float | None = None

    def call(self, tasks: DataFrame) -> DataFrame:
        out = answers(tasks, self.backend) if isinstance(self.backend, Answerer) else self.backend(tasks)
        return out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))


@dataclass(frozen=True)
class AuditPolicy:
    """Whether and how often accepted cases are answered again by the final tier: ``off``, ``inline`` or ``deferred``."""

    mode: str = "inline"
    rate: float = 0.1
    bands: Sequence[tuple[float, float, float]] = field(default_factory=tuple)
    floor: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.mode not in ("off", "inline", "deferred") or not 0 <= self.rate <= 1:
            raise ValueError("audit mode is off, inline or deferred, and its rate lies in [0, 1]")


#: Decides whether two answers are the same: (candidate, target) -> true, false or null.
Judge = Callable[[Column, Column], Column]


def plain_judge(candidate: Column, target: Column) -> Column:
    c, t = F.trim(candidate), F.trim(target)
    return F.when((c == "") & (t == ""), F.lit(None)).when(c == "", F.lit(False)).otherwise(c == t)


def _judged(equal: Column) -> Column:
    return F.when(equal.isNotNull(), struct_of(JUDGEMENT, equivalent=equal, comparator=F.lit("normalized"), calls=F.array()))


def _attempt(tier: Tier, final: bool, judge: Judge) -> Column:
    failed = F.col("error").isNotNull()
    score = F.when(~failed & ~unusable(F.lit("end"), F.col("answer")), finite(F.col("score")))
    accepted = ~failed if final else accepts(score, F.lit(tier.threshold)) & ~failed
    return struct_of(
        ATTEMPT, tier=F.lit(tier.name), backend=F.lit(tier.name), answer=F.when(~failed, F.col("answer")), threshold=F.lit(None if final else tier.threshold), accepted=accepted, error=F.col("error"),
        completion=F.when(~failed, struct_of(COMPLETION, text=F.col("text"), model=F.lit(tier.name), cost_usd=F.col("cost_usd"), latency_s=F.col("latency_s"), stop_reason=F.lit("end"))),
        confidence=F.lit(None) if final else F.when(~failed, struct_of(CONFIDENCE, estimator=F.lit("verbal"), score=score, calls=F.array())),
        correct=F.when(~failed, _judged(judge(F.col("answer"), F.col("reference")))),
    )


_TASK_COLUMNS = ("seq", "id", "prompt", "reference", "meta", "difficulty")


def route(tasks: DataFrame, tiers: Sequence[Tier], run_id: str, mode: str = "serve", audit: AuditPolicy | None = None, judge: Judge = plain_judge) -> DataFrame:
    """Decisions for ``tasks`` (``seq``, ``id``, ``prompt``, ``reference``, ``meta`` and what the backends need).

    ``serve``: a tier sees only what the tiers before it weren't accepted for; then
    accepted cases are drawn for audit. ``eval``: every tier answers every task.
    """
    if mode not in ("serve", "eval") or not tiers:
        raise ValueError("mode is serve or eval, and there is a tier at least")
    extra = [c for c in ("seq", "reference", "meta", "difficulty") if c not in tasks.columns]
    if extra:
        tasks = tasks.withColumns({c: (F.monotonically_increasing_id() if c == "seq" else F.lit(None).cast("double" if c == "difficulty" else "string")) for c in extra})
    state = tasks.select(*_TASK_COLUMNS).withColumn("attempts", F.array().cast(f"array<{ATTEMPT}>"))
    finished = []
    for i, tier in enumerate(tiers):
        final = i == len(tiers) - 1
        answered = tier.call(state).withColumn("attempts", F.concat("attempts", F.array(_attempt(tier, final, judge)))).select(*_TASK_COLUMNS, "attempts")
        state = kept(answered, f"tier-{tier.name}")
        if mode == "serve" and not final:
            last = F.element_at("attempts", -1)["accepted"]
            finished.append(state.where(last))
            state = state.where(~last)
    done = reduce(DataFrame.unionByName, [*finished, state])
    return _decided(done, tiers, run_id, mode, audit, judge)


def _decided(done: DataFrame, tiers: Sequence[Tier], run_id: str, mode: str, audit: AuditPolicy | None, judge: Judge) -> DataFrame:
    final = tiers[-1].name
    attempts = F.col("attempts")
    first = F.get(F.filter(F.transform(attempts, lambda a, i: F.struct(a["accepted"].alias("ok"), i.alias("i"))), lambda x: x["ok"]), F.lit(0))["i"]
    d = done.withColumn("stop", first).withColumn("n_serving", F.coalesce(F.col("stop") + 1, F.size(attempts)))
    if mode == "eval":
        last = F.element_at(attempts, -1)
        agreed = F.transform(attempts, lambda a: F.when((a["tier"] == final) | a["error"].isNotNull() | last["error"].isNotNull(), a).otherwise(a.withField("agreement", _judged(judge(a["answer"], last["answer"])))))
        d = d.withColumn("attempts", agreed)
    a = F.col("attempts")
    served = F.coalesce(F.get(a, F.col("stop")), last_good_attempt(a))
    failure = F.element_at(a, -1)
    error = F.when(F.col("stop").isNull(), F.concat(F.lit("final tier failed: "), F.coalesce(failure["error"], F.lit(""))))
    costs = F.transform(a, attempt_cost)
    serving, other = F.slice(costs, F.lit(1), F.col("n_serving")), F.slice(costs, F.col("n_serving") + 1, F.size(costs))
    d = d.withColumn("served", served).withColumn("error", error).withColumn("serving", sum_or_null(serving)).withColumn("other", sum_or_null(other))
    d = _audited(d, tiers[-1], run_id, audit if mode == "serve" else None, judge)
    return d.select(
        F.lit(run_id).alias("run_id"), F.col("seq").cast("long").alias("seq"), F.lit(mode).alias("mode"), struct_of(TASK, id=F.col("id"), prompt=F.col("prompt"), reference=F.col("reference"), meta=F.col("meta")).alias("task"),
        F.coalesce(F.col("served.answer"), F.lit("")).alias("answer"), F.coalesce(F.col("served.tier"), F.lit(final)).alias("final_tier"), (F.col("n_serving") > 1).alias("escalated"), "attempts", "shadow",
        F.col("serving").alias("cost_usd"), (F.col("other") + F.coalesce("audit_spent", F.lit(0.0))).alias("audit_cost_usd"), F.aggregate(F.slice("attempts", F.lit(1), F.col("n_serving")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["completion"]["latency_s"], F.lit(0.0))).alias("latency_s"),
        F.col("served.correct").alias("correct"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "error",
    ).to(_parse_datatype_string(DECISION))


def _audited(d: DataFrame, final: Tier, run_id: str, audit: AuditPolicy | None, judge: Judge) -> DataFrame:
    none = d.withColumn("shadow", F.lit(None).cast(SHADOW)).withColumn("audit_spent", F.lit(0.0))
    if audit is None or audit.mode == "off":
        return none
    early = F.col("stop").isNotNull() & (F.col("served.tier") != final.name)
    prob = inclusion_prob(F.col("served.confidence.score"), audit.rate, audit.bands, audit.floor)
    drawn = selected(F.lit(str(audit.seed)), F.lit(run_id), F.col("id"), F.col("prob"))
    d = d.withColumn("early", early).withColumn("prob", F.when(early, prob)).withColumn("drawn", F.when(early, drawn))
    shadow = lambda status, **more: struct_of(SHADOW, audit_tier=F.lit(final.name), inclusion_prob=F.col("prob"), status=F.lit(status), **more)
    rest = d.where(~F.coalesce("drawn", F.lit(False)))
    rest = rest.withColumn("shadow", F.when(F.col("early"), shadow("skipped"))).withColumn("audit_spent", F.lit(0.0))
    chosen = d.where("drawn")
    if audit.mode == "deferred":
        chosen = chosen.withColumn("shadow", shadow("pending")).withColumn("audit_spent", F.lit(0.0))
    else:
        chosen = _answered_again(chosen, final, judge, shadow)
    return rest.unionByName(chosen)


def _answered_again(chosen: DataFrame, final: Tier, judge: Judge, shadow: Callable[..., Column]) -> DataFrame:
    called = final.call(chosen.select(*_TASK_COLUMNS)).withColumn("again", _attempt(final, True, judge)).select("seq", "id", "again")
    called = kept(called, "audits")
    out = chosen.join(called, ["seq", "id"])
    eq = F.when(F.col("again.error").isNull(), judge(F.col("served.answer"), F.col("again.answer")))
    failed = F.col("again.error").isNotNull()
    agreement = F.when(~failed, struct_of(JUDGEMENT, equivalent=eq, comparator=F.lit("normalized"), calls=F.array()))
    done = F.when(failed, shadow("error", attempt=F.col("again"))).otherwise(shadow("done", attempt=F.col("again"), agreement=agreement))
    return out.withColumn("shadow", done).withColumn("audit_spent", attempt_cost(F.col("again"))).drop("again")


def complete_audits(decisions: DataFrame, final: Tier, difficulty: Column | None = None, judge: Judge = plain_judge) -> DataFrame:
    """Pending decisions with their audits done; other decisions aren't returned."""
    d = decisions.where(F.col("shadow.status") == "pending")
    names = d.columns
    served = F.get(F.filter("attempts", lambda a: (a["tier"] == F.col("final_tier")) & a["accepted"]), F.lit(0))
    flat = d.select("*", F.col("task.id").alias("id"), F.col("task.prompt").alias("prompt"), F.col("task.reference").alias("reference"), F.col("task.meta").alias("meta"), (difficulty if difficulty is not None else F.lit(None).cast("double")).alias("difficulty"), served.alias("served"), F.col("shadow.inclusion_prob").alias("prob"))
    shadow = lambda status, **more: struct_of(SHADOW, audit_tier=F.lit(final.name), inclusion_prob=F.col("prob"), status=F.lit(status), **more)
    out = _answered_again(flat, final, judge, shadow)
    return out.withColumn("audit_cost_usd", F.col("audit_cost_usd") + F.col("audit_spent")).select(*names)
