"""Additive cells of an audit: made in one scan, merged for any runs or batches, finished into a summary.

A decision falls into one cell: its run, path through the tiers, score bin,
inclusion probability and outcomes. A cell holds counts and sums only, so cells
of batches, runs or periods add up, and those of a decision that was replaced can
be taken off again. What depends on all decisions (which tier is the final one,
response rates, strata) is settled on the cells when a summary is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.functions.exprs import attempt_cost, finite, served_attempt

LAST = "array<struct<tier:string,bad:boolean,eq:boolean>>"
#: What makes a cell. ``kind`` is ``case`` (a row for each decision) or ``cost`` (one for each cost that may stand for a reference tier's).
DIMENSIONS = (
    "kind string, run_id string, mode string, failed boolean, final_tier string, servable boolean, tiers array<string>, finals array<string>, audit_tier string, "
    f"lasts {LAST}, state string, pi double, bin int, disagree boolean, wrong boolean, ref_wrong boolean, role string, tier string"
)
#: What a decision adds to its cell; sums but for the lowest and highest values.
MEASURES = "escalated long, graded long, right long, cost double, cost_n long, audit double, audit_n long, prob double, x double, weight double"
ROW = f"{DIMENSIONS}, {MEASURES}"
_DIMENSIONS, _MEASURES = ([c.split()[0] for c in part.replace(LAST, "lasts").split(", ")] for part in (DIMENSIONS, MEASURES))
_SUMS = ("n", "escalated", "graded", "right", "cost", "cost_n", "audit", "audit_n", "prob", "w", "w2", "x", "xx", "x_n", "xw", "xw2", "wx", "w2x", "w2x2")
_LEAST, _MOST = ("w_min", "x_min", "xw_min"), ("w_max", "x_max", "xw_max")


def _struct(**given: Column) -> Column:
    fields = []
    for part in (DIMENSIONS.replace(LAST, "@"), MEASURES):
        for f in part.split(", "):
            name, kind = f.split()
            fields.append(given.get(name, F.lit(None)).cast(LAST if kind == "@" else kind).alias(name))
    return F.struct(*fields)


def rows(decisions: DataFrame, bin_of: Column, *keep: str | Column) -> DataFrame:
    """For each decision ``rows``, an array of ``ROW``: itself as a ``case``, and its costs; beside it the columns to ``keep``. ``bin_of`` is made of a column ``score``."""
    attempts, shadow = F.col("attempts"), F.col("shadow")
    served = served_attempt(attempts, F.col("final_tier"))
    d = decisions.withColumn("served", served).withColumn("score", finite(served["confidence"]["score"])).withColumn("bin", bin_of)
    served, is_eval, good = F.col("served"), F.col("mode") == "eval", F.col("error").isNull()
    servable = F.coalesce(good & served["accepted"] & served["error"].isNull(), F.lit(False))
    tiers = F.array_distinct(F.transform(attempts, lambda a: a["tier"]))
    lasts = F.transform(tiers, lambda t: F.element_at(F.filter(attempts, lambda a: a["tier"] == t), -1))
    prob = shadow["inclusion_prob"]
    valid = F.coalesce(~F.isnan(prob) & (prob > 0) & (prob < float("inf")), F.lit(False))
    eq = F.when(is_eval, served["agreement"]["equivalent"]).otherwise(F.coalesce(shadow["agreement"], served["agreement"])["equivalent"])
    in_eval = F.when(served["agreement"].isNull(), "unmatched").when(eq.isNull(), "undecided").otherwise("audited")
    status = shadow["status"]
    in_serve = (
        F.when(shadow.isNull(), "none").when(~valid, "invalid").when(status == "done", F.when(eq.isNull(), "undecided").otherwise("audited"))
        .when(status.isin("pending", "error"), status).when(status == "skipped", "not-selected").otherwise("unknown")
    )
    state = F.when(is_eval, in_eval).otherwise(in_serve)
    pi = F.when(is_eval, 1.0).when(shadow.isNotNull() & valid, F.least(F.lit(1.0), prob))
    only = lambda c: F.when(servable, c)  # noqa: E731  what no skipped case needs makes no cells
    right = F.col("correct.equivalent")
    whole = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    case = _struct(
        kind=F.lit("case"), run_id=F.col("run_id"), mode=F.col("mode"), failed=~good, final_tier=F.col("final_tier"), servable=servable, tiers=tiers,
        finals=F.array_distinct(F.transform(F.filter(attempts, lambda a: a["threshold"].isNull()), lambda a: a["tier"])), audit_tier=shadow["audit_tier"],
        lasts=F.when(servable & is_eval, F.transform(lasts, lambda a: F.struct(a["tier"].alias("tier"), a["error"].isNotNull().alias("bad"), a["correct"]["equivalent"].alias("eq")))),
        state=only(state), pi=only(F.bround(pi, 6)), bin=only(F.col("bin")), disagree=only(F.when(state == "audited", ~eq)), wrong=only(~served["correct"]["equivalent"]),
        ref_wrong=only(F.when(~is_eval & (state == "audited"), ~shadow["attempt"]["correct"]["equivalent"])),
        escalated=whole(F.col("escalated")), graded=whole(right.isNotNull()), right=whole(right), cost=F.col("cost_usd"), cost_n=whole(F.col("cost_usd").isNotNull()), audit=F.col("audit_cost_usd"), audit_n=whole(F.col("audit_cost_usd").isNotNull()),
        prob=only(pi), weight=only(1 / pi),
    )

    def cost(role: str, tier: Column, a: Column, there: Column, weight: Column) -> Column:
        x = attempt_cost(a)
        return F.when(good & there & a.isNotNull() & a["error"].isNull() & x.isNotNull(), _struct(kind=F.lit("cost"), run_id=F.col("run_id"), mode=F.col("mode"), final_tier=F.col("final_tier"), servable=servable, role=F.lit(role), tier=tier, x=x, weight=weight))

    one = F.lit(1.0)
    audited = ~is_eval & servable & (status == "done") & (prob > 0) & ~F.isnan(prob)
    each = F.when(is_eval, F.transform(lasts, lambda a: cost("eval", a["tier"], a, is_eval, one))).otherwise(F.array())
    costs = F.concat(each, F.array(cost("served", F.col("final_tier"), served, ~is_eval, one), cost("audit", shadow["audit_tier"], shadow["attempt"], audited, 1 / F.least(one, prob))))
    return d.select(*keep, F.concat(F.array(case), F.filter(costs, lambda c: c.isNotNull())).alias("rows"))


def cells(decisions: DataFrame, bin_of: Column) -> DataFrame:
    """The cells of ``decisions``, summed map-side in one scan.

    No decision is without rows. Spark doesn't know that: for a plain explosion it
    would ask whether there are any, by a filter that makes all of them a second time.
    """
    return summed(rows(decisions, bin_of).select(F.explode_outer("rows").alias("r")).select("r.*"))


def summed(flat: DataFrame, sign: Column | None = None) -> DataFrame:
    """Rows as cells; with ``sign`` (1 or -1) they are added or taken off."""
    s = F.lit(1) if sign is None else sign
    w, x = F.col("weight"), F.col("x")
    sums = {"n": F.lit(1), **{m: F.col(m) for m in _MEASURES if m not in ("x", "weight")}, "w": w, "w2": w * w, "x": x, "xx": x * x, "x_n": x.isNotNull().cast("long"), "xw": F.when(x.isNotNull(), w), "xw2": F.when(x.isNotNull(), w * w), "wx": w * x, "w2x": w * w * x, "w2x2": w * w * x * x}
    seen = {"w": w, "x": x, "xw": F.when(x.isNotNull(), w)}
    ends = [f(seen[c.rpartition("_")[0]]).alias(c) for f, names in ((F.min, _LEAST), (F.max, _MOST)) for c in names]
    return flat.groupBy(*_DIMENSIONS).agg(*[F.sum(sums[c] * s).alias(c) for c in _SUMS], *ends)


def merged(*parts: DataFrame) -> DataFrame:
    """Cells of several parts as those of all; cells that were taken off whole are gone."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ends = [f(c).alias(c) for f, names in ((F.min, _LEAST), (F.max, _MOST)) for c in names]
    return both.groupBy(*_DIMENSIONS).agg(*[F.sum(c).alias(c) for c in _SUMS], *ends).where("n <> 0")


def cases(cube: DataFrame, final: str | None) -> DataFrame:
    """Cells of skipped cases, with the states and outcomes that the final tier settles."""
    before = F.lit(True) if final is None else F.col("final_tier") != final
    last = F.get(F.filter("lasts", lambda a: a["tier"] == F.lit(final)), F.lit(0))
    state = F.when(F.col("state") != "unmatched", F.col("state")).when(last.isNull() | last["bad"], "error").otherwise("none")
    found = cube.where(F.col("kind") == "case").where("servable").where(before)
    answer = F.when((F.col("mode") == "eval") & (F.col("state") == "audited"), ~last["eq"]).otherwise(F.col("ref_wrong"))
    return found.withColumns({"state": state, "ref_wrong": answer})


def weighted(outcome: Column, rate: Column) -> list[Column]:
    """The aggregates of ``WeightedSums`` from cells: each weight is 1 / (pi x ``rate``)."""
    y = F.when(F.col("w").isNotNull() & (F.col("state") == "audited"), outcome)
    w, w2 = F.col("w") / rate, F.col("w2") / (rate * rate)
    there = y.isNotNull()
    return [
        F.sum(F.when(there, F.col("n"))).alias("n"), F.sum(F.when(y, F.col("n"))).alias("k"), F.sum(F.when(there, w)).alias("w"), F.sum(F.when(there, w2)).alias("w2"), F.sum(F.when(y, w)).alias("wy"), F.sum(F.when(y, w2)).alias("w2y"),
        F.max(F.when(there, F.col("w_max") / rate)).alias("w_max"), F.min(F.when(there, F.col("w_min") / rate)).alias("w_min"), F.sum(F.when(y, w2 - w)).alias("vh"), F.sum(F.when(~y, w2 - w)).alias("vm"),
    ]


def reference_cost(cube: DataFrame, final: str | None, reference: str | None) -> dict:
    """Weighted sums of the reference tier's observed costs."""
    role, tier = F.col("role"), F.col("tier")
    skip = F.lit(True) if final is None else F.col("final_tier") != final
    used = (role == "eval") & (tier == F.lit(final)) | (role == "served") & (tier == F.lit(reference)) & F.lit(reference == final) | (role == "audit") & (tier == F.lit(reference)) & skip
    s = cube.where(F.col("kind") == "cost").where(used).agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("x_n", "n"), ("xw", "w"), ("xw2", "w2"), ("wx", "wx"), ("w2x", "w2x"), ("w2x2", "w2x2"))], F.sum("x").alias("sx"), F.sum("xx").alias("sxx"), F.min("xw_min").alias("lo"), F.max("xw_max").alias("hi"), F.min("x_min").alias("x_lo"), F.max("x_max").alias("x_hi")).first().asDict()
    n = s["n"]
    spread = 0.0 if n < 2 or s["x_lo"] == s["x_hi"] else max(0.0, s["sxx"] - s["sx"] ** 2 / n) / (n - 1)
    return {k: s[k] for k in ("n", "w", "w2", "wx", "w2x", "w2x2")} | {"equal": s["lo"] == s["hi"], "sd": spread**0.5 if n > 1 else None}


def columns() -> Sequence[str]:
    return [*_DIMENSIONS, *_SUMS, *_LEAST, *_MOST]
