"""Threshold sweeps over evaluation decisions.

Items are first summed by the buckets that their scores fall in between the
grid's thresholds; all operating points then come from running sums over those
buckets, so the cost of a point doesn't depend on the number of decisions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermeter.functions.exprs import attempt_cost, finite
from tiermeter.functions.intervals import reached, value_at
from tiermeter.operators.calibrate import risk_coverage, running
from tiermeter.sources.tables import kept

# Fixed values.
MOST_POINTS, MOST_GRID, OVER_ONE = 20_000, 101, 1.0001


def usable(n_tiers: int) -> Column:
    """No error, every tier attempted, every completion there."""
    return reduce(lambda x, y: x & y, [F.get("attempts", F.lit(i))["completion"].isNotNull() for i in range(n_tiers)], F.col("error").isNull() & (F.size("attempts") == n_tiers))


def check_runs(decisions: DataFrame) -> None:
    """Only evaluation decisions of one run can be swept."""
    r = decisions.agg(F.count_distinct("run_id").alias("runs"), F.count_if(F.col("mode") != "eval").alias("other")).first()
    if r.runs > 1 or r.other:
        raise ValueError(f"{r.runs} runs, {r.other} decisions not made in eval mode")


def truth_source(decisions: DataFrame, n_tiers: int) -> str:
    """``reference`` if every attempt of the usable decisions is graded, else the last tier's answer."""
    graded = reduce(lambda x, y: x & y, [F.get("attempts", F.lit(i))["correct"].isNotNull() for i in range(n_tiers)])
    return "reference" if decisions.agg(F.coalesce(F.bool_and(F.when(usable(n_tiers), graded)), F.lit(False)).alias("b")).first().b else "audit-tier"


def _of_tier(tier: str, n_tiers: int) -> Column:
    """The first of the ``n_tiers`` attempts that is of ``tier``; by place, since lambdas aren't compiled."""
    at = [F.get("attempts", F.lit(i)) for i in range(n_tiers)]
    return F.coalesce(*[F.when(a["tier"] == F.lit(tier), a) for a in at])


def items(decisions: DataFrame, tiers: Sequence[str], truth: str = "auto") -> DataFrame:
    """Flat rows with ``s{j}``, ``ok{j}``, ``cost{j}`` (with confidence calls), ``base{j}`` and ``lat{j}`` for each tier.

    One pass makes an array of an item, or none for a decision that isn't usable.
    What is asked of the items isn't pushed below the explosion: there each
    condition would bring a copy of all that the attempts are made from.
    """
    n = len(tiers)
    if truth == "auto":
        truth = truth_source(decisions, n)
    columns = [F.col("task.id").alias("task_id")]
    for j, tier in enumerate(tiers, start=1):
        a = _of_tier(tier, n)
        last = j == n
        right = a["correct"]["equivalent"] if truth == "reference" else F.lit(True) if last else a["agreement"]["equivalent"]
        columns += [finite(a["confidence"]["score"]).alias(f"s{j}"), F.coalesce(right, F.lit(False)).alias(f"ok{j}"), attempt_cost(a).alias(f"cost{j}"), a["completion"]["cost_usd"].alias(f"base{j}"), a["completion"]["latency_s"].alias(f"lat{j}")]
    return decisions.select(F.explode(F.when(usable(n), F.array(F.struct(*columns)))).alias("item")).select("item.*")


def default_grid(scores: DataFrame, column: str, most: int = MOST_GRID) -> list[float]:
    """The distinct scores, at most ``most`` of them by even rank, and 0 and a value over 1."""
    distinct = scores.where(F.col(column).isNotNull()).select(F.col(column).alias("score")).distinct().withColumn("one", F.lit(1))
    n = distinct.count()
    ranks = {round(i * (n - 1) / (most - 1)) + 1 for i in range(most)} if n > most else None
    ranked = running(distinct, {"one": "rank"})
    if ranks:
        ranked = ranked.where(F.col("rank").isin(*sorted(ranks)))
    return sorted({0.0, OVER_ONE, *(r.score for r in ranked.select("score").collect())})  # ``most`` rows at most


def joint_cap(gated: int, most: int = MOST_POINTS) -> int:
    """The largest grid for each of ``gated`` tiers with at most ``most`` points together."""
    k = int(most ** (1 / gated)) + 1
    while k**gated > most:
        k -= 1
    return k


def bucket(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of the ascending grid the score reaches; none for null."""
    return reached(score, grid)


def points(rows: DataFrame, grids: Sequence[Sequence[float]]) -> DataFrame:
    """One row for each combination of thresholds.

    ``rows``: ``s{j}`` of the gated tiers, ``ok{j}``, and optionally ``cost{j}`` and
    ``lat{j}`` of all tiers. An item is served by the first tier whose score
    reaches its threshold, else by the last. Its cost is the sum over the tiers
    it walked; a point with an unknown cost among its items has none.
    """
    gated = len(grids)
    grids = [sorted(g) for g in grids]
    total = math.prod(map(len, grids))
    if total > MOST_POINTS:
        raise ValueError(f"{total} points; {MOST_POINTS} are the most")
    tiers = gated + 1
    have = [m for m in ("cost", "lat") if f"{m}1" in rows.columns]
    sums = [F.count("*").alias("n")]
    for j in range(1, tiers + 1):
        sums.append(F.count_if(f"ok{j}").alias(f"right{j}"))
        for m in have:
            walked = reduce(lambda x, y: x + y, [F.col(f"{m}{i}") for i in range(1, j + 1)])
            sums += [F.sum(walked).alias(f"{m}{j}"), F.count_if(walked.isNull()).alias(f"no_{m}{j}")]
    dims = [f"b{j}" for j in range(1, gated + 1)]
    cells = rows.withColumns({d: bucket(F.col(f"s{j}"), grids[j - 1]) for j, d in enumerate(dims, start=1)}).groupBy(*dims).agg(*sums)
    cells = kept(cells, "cells")  # a row for each cell of the grid; all sums below start from it
    measures = [c for c in cells.columns if c not in dims]
    dense = rows.sparkSession.range(1).drop("id")
    for d, g in zip(dims, grids, strict=True):
        dense = dense.withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(len(g)))))
    full = dense.join(cells, dims, "left").fillna(0, measures)
    for d in dims:
        by = Window.partitionBy(*[x for x in dims if x != d]).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({m: F.sum(m).over(by) for m in measures})
    # below[k]: what the first k tiers all declined, by their k thresholds.
    below = []
    for k in range(gated + 1):
        cut = full
        for d, g in list(zip(dims, grids, strict=True))[k:]:
            cut = cut.where(F.col(d) == len(g))
        below.append(cut.select(*dims[:k], *[F.col(m).alias(f"{m}_{k}") for m in measures]))
    out = below[gated]
    for k in range(gated - 1, -1, -1):
        out = out.join(F.broadcast(below[k]), dims[:k]) if k else out.crossJoin(F.broadcast(below[0]))  # one row, or MOST_POINTS at most
    for d, g in zip(dims, grids, strict=True):
        out = out.where(F.col(d) < len(g))

    def served(measure: str) -> list[Column]:
        per_tier = []
        for j in range(1, tiers + 1):
            name = "n" if measure == "n" else f"{measure}{j}"
            seen = F.col(f"{name}_{j - 1}")
            per_tier.append(seen - F.col(f"{name}_{j}") if j < tiers else seen)
        return per_tier

    add = lambda cs: reduce(lambda x, y: x + y, cs)
    columns = [value_at(F.col(d), g).alias(f"t{j}") for j, (d, g) in enumerate(zip(dims, grids, strict=True), start=1)]
    n = F.col("n_0")
    counts, right = served("n"), served("right")
    columns += [n.alias("n"), add(right).alias("correct"), (n - counts[0]).alias("escalated"), *[c.alias(f"served{j}") for j, c in enumerate(counts, start=1)], (add(counts[:-1]) - add(right[:-1])).alias("skipped_wrong")]
    for m in have:
        columns.append(F.when(add(served(f"no_{m}")) == 0, add(served(m)) / n).alias("cost_per_task" if m == "cost" else "latency_per_task"))
    return out.select(columns)


def baselines(rows: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Each tier alone, at its base cost without confidence calls."""
    one = [rows.agg(F.lit(f"only:{t}").alias("name"), F.count("*").alias("n"), F.count_if(f"ok{j}").alias("correct"), F.when(F.count("*") == F.count(f"base{j}"), F.avg(f"base{j}")).alias("cost_per_task")) for j, t in enumerate(tiers, start=1)]
    return reduce(DataFrame.union, one)


def oracle(rows: DataFrame, n_tiers: int) -> DataFrame:
    """The cheapest right tier for each item (unknown costs last, earlier tiers first), else the cheapest."""
    choices = F.array(*[F.struct((~F.col(f"ok{j}")).alias("wrong"), F.coalesce(F.col(f"base{j}"), F.lit(float("inf"))).alias("cost"), F.lit(j).alias("tier")) for j in range(1, n_tiers + 1)])
    best = rows.select(F.array_min(choices).alias("b"))
    return best.agg(F.count("*").alias("n"), F.count_if(~F.col("b.wrong")).alias("correct"), F.when(F.count_if(F.col("b.cost") == float("inf")) == 0, F.avg("b.cost")).alias("cost_per_task"), *[F.count_if(F.col("b.tier") == j).alias(f"served{j}") for j in range(1, n_tiers + 1)])


def frontier(table: DataFrame, cost: str = "cost_per_task", accuracy: str = "accuracy", order: Sequence[str] = ()) -> DataFrame:
    """Points that no cheaper or equally cheap one matches in accuracy.

    The table has at most ``MOST_POINTS`` rows, so one window sees them all.
    """
    key = F.format_string("%.11e", F.col(cost)).cast("double")
    before = Window.orderBy(key, F.col(accuracy).desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    best = table.where(F.col(cost).isNotNull()).withColumn("__best", F.max(accuracy).over(before))
    return best.where(F.col("__best").isNull() | (F.col(accuracy) > F.col("__best") + 1e-12)).drop("__best")


def choose(table: DataFrame, objective: str, target: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row: the cheapest at the target accuracy, the most accurate, or the least accurate that reaches it."""
    acc, cost = F.col("accuracy"), F.col("cost_per_task")
    known = table.where(cost.isNotNull())
    if objective == "max-accuracy":
        return known.orderBy(acc.desc(), cost, F.col("escalated"), *order).limit(1)
    if target is None:
        raise ValueError(f"{objective} needs a target accuracy")
    reached = known.where(acc >= target - 1e-12)
    if objective == "max-savings":
        return reached.orderBy(cost, acc.desc(), F.col("escalated"), *order).limit(1)
    if objective == "min-accuracy":
        return reached.orderBy(acc, cost, F.col("escalated"), *order).limit(1)
    raise ValueError(f"unknown objective {objective!r}; known: max-savings, max-accuracy, min-accuracy")


def split(rows: DataFrame, holdout: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Selection and holdout rows by a hash of the task id, without a shuffled list of ids."""
    if not 0 <= holdout < 1:
        raise ValueError("holdout must lie in [0, 1)")
    u = F.pmod(F.xxhash64("task_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(u >= holdout), rows.where(u < holdout)


def recommend(rows: DataFrame, grids: Sequence[Sequence[float]], objective: str = "max-savings", target: float | None = None, holdout: float = 0.3, seed: int = 0) -> dict | None:
    """Thresholds chosen on one part of the items, and their figures on the held-out part."""
    chosen_on, checked_on = split(rows, holdout, seed)
    names = [f"t{j}" for j in range(1, len(grids) + 1)]
    if target is None and objective != "max-accuracy":
        best = chosen_on.agg(F.greatest(*[F.avg(F.col(f"ok{j}").cast("double")) for j in range(1, len(grids) + 2)]).alias("a")).first().a
        target = best
    found = choose(points(chosen_on, grids).withColumn("accuracy", F.col("correct") / F.col("n")), objective, target, names).first()
    if found is None:
        return None
    held = points(checked_on, [[found[t]] for t in names]).withColumn("accuracy", F.col("correct") / F.col("n")).first() if holdout else None
    return {"thresholds": [found[t] for t in names], "selection": found.asDict(), "holdout": held.asDict() if held else None, "target": target}


def pick_threshold(pairs: DataFrame, target_error: float, at_least: int = 20) -> DataFrame:
    """The lowest observed score from which at least ``at_least`` items have an error rate within the target."""
    return risk_coverage(pairs).where((F.col("covered") >= at_least) & (F.col("risk") <= target_error)).agg(F.min("score").alias("threshold"))
