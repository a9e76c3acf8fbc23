"""Bootstrap of any statistic that sums finish: Poisson weights carried through its sufficient sums.

In each replicate a row counts Poisson(1) times. The count comes from a hash of the
seed, the row's key and the replicate, so it is the same at any partitioning and in
a task that runs again. Each Arrow batch makes the counts of its rows for all
replicates as a matrix, multiplies it with the rows' measures, and adds the result
to the task's sums for each group and replicate; no row is exploded. Only those sums
are shuffled, and a statistic is then finished for all replicates at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermeter.functions.stats import REPLICATES, Estimate

#: Sums that a task holds before it gives them on, and cells of one matrix of counts.
HELD_SUMS, CELLS = 1 << 20, 1 << 20
#: Poisson(1) up to where 52 bits see no more of it.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def counts(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """How often each row (its 64-bit key hash) counts in replicates 1 to ``reps``; replicate 0 is the data themselves."""
    with np.errstate(over="ignore"):
        steps = _mixed((np.arange(1, reps + 1, dtype=_U) + _U(seed) * _U(0x9E3779B97F4A7C15)) * _U(0x9E3779B97F4A7C15))
        noise = _mixed(keys.astype(np.int64).view(_U)[:, None] ^ steps[None, :])
    uniform = (noise >> _U(12)).astype(np.float64) / float(1 << 52)
    drawn = np.searchsorted(_POISSON, uniform.ravel(), side="right").reshape(len(keys), reps)
    return np.concatenate((np.ones((len(keys), 1)), drawn), axis=1)


def replicate_sums(rows: DataFrame, key: str | Sequence[str], measures: dict[str, Column], by: Sequence[str] = (), reps: int = REPLICATES, seed: int = 0) -> DataFrame:
    """``rep`` (0 to ``reps``), ``by`` and the sums of ``measures`` there, null measures as 0.

    ``key`` names the rows: rows that share it count together. Groups of ``by`` may
    be many: a task gives its sums on when they grow.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(measures)
    flat = rows.select(F.xxhash64(*[F.col(k) for k in keys]).alias("__key"), *by, *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(n) for n, m in measures.items()])
    schema = T.StructType([T.StructField("rep", T.IntegerType()), *[flat.schema[b] for b in by], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        target: pa.Schema | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                repeated = [pa.array([v] * (reps + 1), target.field(b).type) for b, v in zip(by, group, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps + 1, dtype=np.int32)), *repeated, *(pa.array(sums[:, j]) for j in range(len(names)))], schema=target)
            held.clear()

        for batch in batches:
            target = pa.schema([("rep", pa.int32()), *(batch.schema.field(b) for b in by), *((n, pa.float64()) for n in names)])
            groups = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True)) if by else [()] * batch.num_rows
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            code = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            at = np.fromiter((code[g] for g in groups), dtype=np.int64, count=len(groups))
            hashes = batch.column("__key").to_numpy()
            for first in range(0, batch.num_rows, step := max(1, CELLS // (reps + 1))):
                part = slice(first, first + step)
                drawn = counts(hashes[part], reps, seed)
                order = np.argsort(at[part], kind="stable")
                where, begin = np.unique(at[part][order], return_index=True)
                for j, (g, own) in enumerate(zip(where, np.split(order, begin[1:]), strict=True)):
                    group = groups[first + own[0]]
                    add = drawn[own].T @ values[part][own]
                    held[group] = held[group] + add if group in held else add
            if len(held) * (reps + 1) * len(names) > HELD_SUMS:
                yield from flush()
        if target is not None:
            yield from flush()

    return flat.mapInArrow(run, schema).groupBy("rep", *by).agg(*[F.sum(n).alias(n) for n in names])


def interval(finished: DataFrame, n: int, level: float = 0.95) -> Estimate | None:
    """The percentile interval of ``value`` by ``rep``; replicates without a value are left out. None if the data have none."""
    rows = {r.rep: r.value for r in finished.select("rep", "value").collect()}  # a row for each replicate
    if rows.get(0) is None:
        return None
    drawn = [v for k, v in rows.items() if k and v is not None]
    lo, hi = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2]) if drawn else (None, None)
    return Estimate(rows[0], None if lo is None else float(lo), None if hi is None else float(hi), n, "bootstrap", level)


def bootstrap(rows: DataFrame, key: str | Sequence[str], measures: dict[str, Column], finish: Callable[[DataFrame], DataFrame], by: Sequence[str] = (), reps: int = REPLICATES, seed: int = 0, level: float = 0.95) -> Estimate | None:
    """The interval of what ``finish`` makes of the replicates' sums: ``rep`` and ``value``."""
    n = rows.count()
    return interval(finish(replicate_sums(rows, key, measures, by, reps, seed)), n, level) if n else None


def ratio(rows: DataFrame, key: str | Sequence[str], value: Column, weight: Column, **options) -> Estimate | None:
    """The weighted mean of ``value``; rows without either are left out."""
    known = rows.withColumns({"__v": value.cast("double"), "__w": weight.cast("double")}).where("__v is not null and __w is not null")
    return bootstrap(known, key, {"wx": F.col("__w") * F.col("__v"), "w": F.col("__w")}, lambda s: s.select("rep", F.try_divide("wx", "w").alias("value")), **options)


def auroc(pairs: DataFrame, key: str | Sequence[str], score: str = "score", label: str = "label", **options) -> Estimate | None:
    """The area under the ROC curve, with half credit for ties; sums are by distinct score."""
    known = pairs.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).withColumnRenamed(score, "__score")
    positive = F.col(label).cast("boolean").cast("int")

    def finish(sums: DataFrame) -> DataFrame:
        below = F.sum("neg").over(Window.partitionBy("rep").orderBy("__score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
        won = sums.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        return won.groupBy("rep").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("value"))

    return bootstrap(known, key, {"pos": positive, "neg": 1 - positive}, finish, by=("__score",), **options)
