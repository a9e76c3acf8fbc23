"""Calibration measures and isotonic maps over (score, label) rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermeter.functions.exprs import piecewise
from tiermeter.functions.intervals import reached, value_at
from tiermeter.sources.tables import kept

BINS = 10
#: Ranges of scores that running sums are dealt to.
RANGES = 256


def brier(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return pairs.agg(F.avg(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("brier"))


def bucket(score: Column, bins: int = BINS) -> Column:
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def reliability(pairs: DataFrame, score: str = "score", label: str = "label", bins: int = BINS) -> DataFrame:
    """Every equal-width bin, the empty ones too: count, mean score and accuracy."""
    spark = pairs.sparkSession
    got = pairs.groupBy(bucket(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.count_if(F.col(label).cast("boolean")).alias("k"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})


def ece(pairs: DataFrame, score: str = "score", label: str = "label", bins: int = BINS) -> DataFrame:
    per = pairs.groupBy(bucket(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(F.col(label).cast("double")) - F.avg(score)).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def by_score(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Counts by distinct score: what all rank measures need."""
    return pairs.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("k"))


def running(per: DataFrame, columns: dict[str, str], descending: bool = False) -> DataFrame:
    """Running sums over scores, in ranges of scores rather than in one task.

    Scores are dealt to ``RANGES`` fixed ranges of [0, 1] (scores beyond it belong
    to the end ranges); each range sums its own rows by a window, and gets the
    totals of the ranges before it.
    """
    order = F.col("score").desc() if descending else F.col("score")
    place = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("score") * RANGES)))
    dealt = per.withColumn("__part", (F.lit(RANGES) - place if descending else place).cast("int"))
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in columns])
    own = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "__part")
    for c, name in columns.items():
        out = out.withColumn(name, F.sum(c).over(own) + F.col(f"__o_{c}"))
    return out.drop("__part", *[f"__o_{c}" for c in columns])


def auroc(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney with half credit for ties; null if a class is missing."""
    per = by_score(pairs, score, label).withColumn("neg", F.col("n") - F.col("k"))
    run = running(per, {"neg": "upto"})
    won = F.sum(F.col("k") * (F.col("upto") - F.col("neg")) + F.lit(0.5) * F.col("k") * F.col("neg"))
    return run.agg(F.try_divide(won, (F.sum("k") * F.sum("neg")).cast("double")).alias("auroc"))


def risk_coverage(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One point for each distinct score from the top: coverage and error rate among those covered."""
    per = by_score(pairs, score, label).withColumn("bad", F.col("n") - F.col("k"))
    run = running(per, {"n": "covered", "bad": "wrong"}, descending=True)
    total = per.agg(F.sum("n").alias("total"))
    return run.crossJoin(F.broadcast(total)).select("score", "covered", "wrong", (F.col("covered") / F.col("total")).alias("coverage"), (F.col("wrong") / F.col("covered")).alias("risk"), (F.col("n") / F.col("total")).alias("step"))  # total has one row


def aurc(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return risk_coverage(pairs, score, label).agg(F.sum(F.col("risk") * F.col("step")).alias("aurc"))


def curve(pairs: DataFrame, most: int = 200, score: str = "score", label: str = "label") -> DataFrame:
    """The risk-coverage points, one at most for each of ``most`` equal ranges of coverage: its last."""
    part = F.least(F.lit(most - 1), F.floor(F.col("coverage") * most))
    return risk_coverage(pairs, score, label).groupBy(part.alias("part")).agg(F.max(F.struct("coverage", "risk", "score")).alias("p")).select("p.*")


def measures(pairs: DataFrame, score: str = "score", label: str = "label") -> dict:
    """How far scores can be trusted: counts, ECE, Brier, AUROC, AURC and reliability bins.

    Rows without a finite score count as ``missing`` only. ECE, Brier and bins need all
    scores to lie in [0, 1], and are None or empty otherwise, as is all of it without scores.
    """
    known = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    there = pairs.where(known).select(F.col(score).alias("score"), F.col(label).cast("boolean").alias("label"))
    n = pairs.agg(F.count_if(known).alias("n"), F.count_if(~known).alias("missing"), F.coalesce(F.bool_and(F.when(known, F.col(score).between(0, 1))), F.lit(True)).alias("within")).first()
    out: dict = {"n": n.n, "missing": n.missing, "ece": None, "brier": None, "auroc": None, "aurc": None, "reliability": []}
    if not n.n:
        return out
    out |= {"auroc": auroc(there).first().auroc, "aurc": aurc(there).first().aurc}
    if n.within:
        out |= {"ece": ece(there).first().ece, "brier": brier(there).first().brier, "reliability": [r.asDict() for r in reliability(there).orderBy("bin").collect()]}  # BINS rows
    return out


Block = list  # [lowest score, highest score, positive labels, rows]


def push(stack: list[Block], block: Block) -> None:
    """Put a block on a stack of rising means; blocks whose means don't rise are pooled, by whole numbers."""
    stack.append(block)
    while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
        lo, _, k, n = stack[-2]
        _, hi, k2, n2 = stack.pop()
        stack[-1] = [lo, hi, k + k2, n + n2]


def knots_of(blocks: Iterable[Block]) -> list[tuple[float, float]]:
    """Both ends of each block with its mean; one knot for a block of a single score."""
    return [(x, k / n) for lo, hi, k, n in blocks for x in ((lo,) if lo == hi else (lo, hi))]


BLOCKS = "lo double, hi double, k long, n long"
#: Ranges of scores that are pooled side by side, then the merges of their stacks.
POOL_ROUNDS = (RANGES, 16, 1)
#: Blocks that are sent to the rows as edges; more meet them by ranges.
MOST_EDGES = 1 << 18


def _pooled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block stack of one range; its rows come in ascending order."""
    stack: list[Block] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            push(stack, list(row))
    for first in range(0, len(stack), 10_000):
        columns = zip(*stack[first : first + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["lo", "hi", "k", "n"])


def isotonic_blocks(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``lo``, ``hi``, ``k``, ``n``: the blocks of the isotonic fit, as a written table.

    Adjacent violators are pooled within ranges of scores, one task each; the
    ranges' stacks are then merged in fewer and fewer tasks, which is exact, as
    pooling what is pooled gives the same blocks. Scores aren't rounded. The last
    task holds no more than the blocks that are left: steps of the map, far
    fewer than scores unless labels rise with them throughout. Rows without a score
    don't count; a null label is a negative one.
    """
    known = pairs.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    blocks = by_score(known, score, label).select(F.col("score").cast("double").alias("lo"), F.col("score").cast("double").alias("hi"), "k", "n")
    for parts in POOL_ROUNDS:
        dealt = blocks.repartitionByRange(parts, "lo") if parts > 1 else blocks.coalesce(1)
        blocks = kept(dealt.sortWithinPartitions("lo").mapInArrow(_pooled, BLOCKS), "blocks")
    return blocks


def fit_isotonic(pairs: DataFrame, score: str = "score", label: str = "label") -> list[tuple[float, float]]:
    """Knots of the isotonic map; the driver gets the blocks only."""
    return knots_of([r.lo, r.hi, r.k, r.n] for r in isotonic_blocks(pairs, score, label).orderBy("lo").collect())


def isotonic_table(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``score`` and ``fitted`` for each distinct score: the mean of its block."""
    blocks = isotonic_blocks(pairs, score, label)
    per = by_score(pairs.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))), score, label).select(F.col("score").cast("double").alias("score"))
    if blocks.count() <= MOST_EDGES:
        rows = blocks.orderBy("lo").collect()
        return per.select("score", value_at(reached(F.col("score"), [r.lo for r in rows]) - 1, [r.k / r.n for r in rows]).alias("fitted"))
    # Blocks and scores meet in ranges; what a range starts in comes from the last block before it.
    place = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("score") * RANGES))).cast("int").alias("part")
    starts = blocks.select(F.col("lo").alias("score"), (F.col("k") / F.col("n")).alias("mean")).select("score", "mean", place)
    both = starts.withColumn("row", F.lit(0)).unionByName(per.select("score", F.lit(None).cast("double").alias("mean"), place, F.lit(1).alias("row")))
    last = starts.groupBy("part").agg(F.max_by("mean", "score").alias("mean"))
    before = F.last("mean", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # RANGES rows
    parts = pairs.sparkSession.range(RANGES).select(F.col("id").cast("int").alias("part")).join(last, "part", "left").select("part", before.alias("before"))
    own = F.last("mean", ignorenulls=True).over(Window.partitionBy("part").orderBy("score", "row").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("own", own).where("row = 1").join(F.broadcast(parts), "part")
    return met.select("score", F.coalesce("own", "before").alias("fitted"))


def step_map(x: Column, knots: list[tuple[float, float]]) -> Column:
    return piecewise(x, knots)


def thin_knots(knots: list[tuple[float, float]], most: int = 20, decimals: int = 4) -> list[tuple[float, float]]:
    """At most ``most`` knots: the inner knot nearest to its neighbours' line goes first; then rounded."""
    k = list(knots)
    while len(k) > most:
        off = [abs(k[i][1] - (k[i - 1][1] + (k[i + 1][1] - k[i - 1][1]) * (k[i][0] - k[i - 1][0]) / (k[i + 1][0] - k[i - 1][0]))) for i in range(1, len(k) - 1)]
        del k[1 + off.index(min(off))]
    out: dict[float, float] = {}
    for x, y in k:
        out[round(x, decimals)] = round(y, decimals)
    return sorted(out.items())


def cross_fitted(pairs: DataFrame, score: str = "score", label: str = "label", key: str = "event_id") -> dict[str, float]:
    """ECE and Brier before, after, and with each half mapped by the other half's fit.

    Halves come from a hash of ``key``, not from a shuffled list.
    """
    half = F.pmod(F.xxhash64(key), F.lit(2))
    maps = [fit_isotonic(pairs.where(half == h), score, label) for h in (0, 1)]
    whole = fit_isotonic(pairs, score, label)
    mapped = pairs.withColumns({"__own": step_map(F.col(score), whole), "__other": F.when(half == 0, step_map(F.col(score), maps[1])).otherwise(step_map(F.col(score), maps[0]))})
    out: dict[str, float] = {}
    for name, c in (("before", score), ("after", "__own"), ("crossed", "__other")):
        out[f"ece_{name}"] = ece(mapped, c, label).first().ece
        out[f"brier_{name}"] = brier(mapped, c, label).first().brier
    return out
