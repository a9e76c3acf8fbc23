"""Redrawing audits over many seeds: coverage of the intervals, and stressed designs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.functions.stats import REPLICATES, Estimate, WeightedSums, finite_bounds_many, status_of, weighted_proportion


#: Strata whose sums a task of ``redraw`` holds; the seeds' sums of more go on to the shuffle.
HELD_STRATA = 64
_ODD = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def redraw(cases: DataFrame, seeds: int, first_seed: int = 0) -> DataFrame:
    """For each seed and stratum: how many of its cases were drawn, and how many of those disagree.

    ``cases``: ``task_id``, ``pi``, ``disagree``. Each case is drawn where
    ``xxhash64(task_id, seed)`` as a number in [0, 1) is below its probability;
    seeds are 32-bit integers. Cases aren't exploded over the seeds: Spark hashes
    the id, an Arrow batch takes the hash on for one seed after the other, and a
    task gives a row for each seed and stratum. Cases are dealt to all cores
    first, as their redraws take far longer than their scan.
    """
    if not -(1 << 31) <= first_seed <= first_seed + seeds <= 1 << 31:
        raise ValueError("seeds are 32-bit integers")
    of_seed = [np.uint64(s & 0xFFFFFFFF) for s in range(first_seed, first_seed + seeds)]
    p1, p2, p3, p5 = _ODD

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[float, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for pi, (drawn, hits) in held.items():
                at = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array((at + first_seed).astype(np.int32)), pa.array(np.full(len(at), pi)), pa.array(drawn[at]), pa.array(hits[at])], names=["seed", "pi", "drawn", "hits"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            h, pi, bad = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.lexsort((bad, pi))
            base, pi, bad = h[order].view(np.uint64) + (p5 + np.uint64(4)), pi[order], bad[order]
            starts = np.flatnonzero(np.r_[True, (pi[1:] != pi[:-1]) | (bad[1:] != bad[:-1])])
            least = np.ceil(np.fmin(pi, 1.0) * float(1 << 53)).astype(np.uint64)
            x, y, under, counts = np.empty_like(base), np.empty_like(base), np.empty(len(base), bool), np.empty((seeds, len(starts)), np.int64)
            for k, s in enumerate(of_seed):
                with np.errstate(over="ignore"):
                    np.bitwise_xor(base, s * p1, out=x)
                np.right_shift(x, np.uint64(41), out=y)
                np.left_shift(x, np.uint64(23), out=x)
                np.bitwise_or(x, y, out=x)
                np.multiply(x, p2, out=x)
                np.add(x, p3, out=x)
                for shift, odd in ((33, p2), (29, p3), (32, None)):
                    np.right_shift(x, np.uint64(shift), out=y)
                    np.bitwise_xor(x, y, out=x)
                    if odd is not None:
                        np.multiply(x, odd, out=x)
                np.right_shift(x, np.uint64(11), out=x)
                np.less(x, least, out=under)
                np.add.reduceat(under, starts, dtype=np.int64, out=counts[k])
            for j, i in enumerate(starts):
                sums = held.get(float(pi[i]))
                if sums is None:
                    if len(held) >= HELD_STRATA:
                        yield from flush()
                    sums = held[float(pi[i])] = np.zeros((2, seeds), np.int64)
                sums[0] += counts[:, j]
                if bad[i]:
                    sums[1] += counts[:, j]
        yield from flush()

    rows = cases.where(F.col("pi") > 0).select(F.xxhash64("task_id").alias("h"), F.col("pi").cast("double").alias("pi"), F.coalesce("disagree", F.lit(False)).alias("bad"))
    drawn = rows.repartition(2 * cases.sparkSession.sparkContext.defaultParallelism, "h").mapInArrow(run, "seed int, pi double, drawn long, hits long")
    return drawn.groupBy("seed", "pi").agg(F.sum("drawn").alias("drawn"), F.sum("hits").alias("hits"))


INTERVALS = "seed long, n long, value double, lo double, hi double, status string"


def intervals(draws: DataFrame, tolerance: float | None = None, level: float = 0.95) -> DataFrame:
    """The weighted estimate and finite-population interval of each seed."""

    target = pa.schema([("seed", pa.int64()), ("n", pa.int64()), ("value", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64()), ("status", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = [sums_of([(s["pi"], s["drawn"], s["hits"]) for s in strata]) for strata in batch.column("strata").to_pylist()]
                value, lo, hi = bounds(sums, level)
                status = [status_of(Estimate(v, a, z, s.n, "hajek-finite"), tolerance) for v, a, z, s in zip(value, lo, hi, sums, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("seed"), pa.array([s.n for s in sums], pa.int64()), pa.array(value, pa.float64()), pa.array(lo), pa.array(hi), pa.array(status)], schema=target)

    per_seed = draws.groupBy(F.col("seed").cast("long").alias("seed")).agg(F.sort_array(F.collect_list(F.struct("pi", "drawn", "hits"))).alias("strata"))  # a few strata
    return per_seed.repartition(draws.sparkSession.sparkContext.defaultParallelism, "seed").mapInArrow(run, INTERVALS)  # few rows, but long to finish


def bounds(sums: Sequence[WeightedSums], level: float = 0.95) -> tuple[list[float], list[float], list[float]]:
    """Estimates and their bounds, for many draws at once; a census has its own exact bounds."""
    column = lambda k: np.array([getattr(s, k) for s in sums], dtype=float)
    w, wy, vh, vm = column("w"), column("wy"), column("vh"), column("vm")
    lo, hi = finite_bounds_many(w, column("w_max"), wy, vh, vm, level)
    for i, s in enumerate(sums):
        if not (s.vh or s.vm):
            e = weighted_proportion(s, level, finite=True)
            lo[i], hi[i] = e.lo, e.hi
    value = wy / w
    return value.tolist(), np.minimum(lo, value).tolist(), np.maximum(hi, value).tolist()


def sums_of(strata: Sequence[tuple[float, int, int]]) -> WeightedSums:
    used = [(1 / p, n, k) for p, n, k in strata if n]
    f = lambda g: math.fsum(g(w, n, k) for w, n, k in used)
    return WeightedSums(
        sum(n for _, n, _ in used), sum(k for *_, k in used), f(lambda w, n, k: w * n), f(lambda w, n, k: w * w * n), f(lambda w, n, k: w * k), f(lambda w, n, k: w * w * k),
        max((w for w, *_ in used), default=0.0), min((w for w, *_ in used), default=math.inf), f(lambda w, n, k: w * (w - 1) * k), f(lambda w, n, k: w * (w - 1) * (n - k)),
    )


def coverage(found: DataFrame, truth: float) -> DataFrame:
    """How often the intervals hold ``truth``, how they miss, their width and the estimate's spread."""
    t = F.lit(float(truth))
    return found.agg(
        F.count("*").alias("seeds"), F.avg(((F.col("lo") <= t) & (t <= F.col("hi"))).cast("double")).alias("coverage"), F.avg((F.col("lo") > t).cast("double")).alias("too_high"), F.avg((F.col("hi") < t).cast("double")).alias("too_low"),
        F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "breach", "inconclusive")],
    )


def designs(spark, strata: Sequence[tuple[int, float, int]], draws: int, level: float = 0.95, seed: int = 0, tasks: int = 8) -> DataFrame:
    """Intervals of a synthetic population of (cases, probability, disagreements) strata, redrawn ``draws`` times.

    Counts by stratum are binomial, so no unit is ever written out. Draws without
    a single audit have no estimate and give no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = batch.column("id").to_pylist(), []
            for k in ids:
                rng = np.random.default_rng([seed, k])
                drawn = []
                for n, p, bad in strata:
                    hits = int(rng.binomial(bad, p))
                    drawn.append((p, hits + int(rng.binomial(n - bad, p)), hits))
                sums.append(sums_of(drawn))
            full = [(k, s) for k, s in zip(ids, sums, strict=True) if s.n]
            value, lo, hi = bounds([s for _, s in full], level)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int64()), pa.array([s.n for _, s in full], pa.int64()), pa.array(value, pa.float64()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.nulls(len(full), pa.string())], names=["seed", "n", "value", "lo", "hi", "status"])

    return spark.range(0, draws, 1, tasks).mapInArrow(run, INTERVALS)


def bootstrap_mean(rows: DataFrame, value: str, level: float = 0.95, reps: int = REPLICATES, seed: int = 0) -> Estimate | None:
    """Percentile bootstrap of a column's mean, nulls and NaN left out; None without values.

    Each row counts Poisson(1) times in each replicate, which needs no knowledge of
    the number of rows: every task adds up ``reps`` sums and counts, and only these
    are shuffled. The weights follow the seed, the task and the batch.
    """
    schema = "sums array<double>, counts array<double>, total double, n long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, total, n = np.zeros(reps), np.zeros(reps), 0.0, 0
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            for k in range(0, len(x), 256):
                part = x[k : k + 256]
                weight = rng.poisson(1.0, (reps, len(part)))
                sums += weight @ part
                counts += weight.sum(axis=1)
            total, n = total + x.sum(), n + len(x)
        yield pa.RecordBatch.from_pylist([{"sums": sums.tolist(), "counts": counts.tolist(), "total": float(total), "n": n}])

    column = F.col(value).cast("double")
    parts = rows.select(column.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).mapInArrow(run, schema)
    at = parts.select("total", "n", F.posexplode(F.arrays_zip("sums", "counts")).alias("rep", "z")).groupBy("rep").agg(F.sum("z.sums").alias("s"), F.sum("z.counts").alias("c"), F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # ``reps`` rows
    if not at or not at[0].n:
        return None
    means = [r.s / r.c for r in at if r.c]
    lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return Estimate(at[0].total / at[0].n, float(lo), float(hi), int(at[0].n), "bootstrap", level)
