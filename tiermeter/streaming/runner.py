"""A resumable runner over a stream of tasks, and an audit that follows the log."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermeter.operators.audit import add_sums, cases, weighted_cases, weighted_sums
from tiermeter.operators.cascade import AuditPolicy, Tier, complete_audits, route
from tiermeter.functions.stats import Estimate, weighted_proportion
from tiermeter.sources.ledger import Ledger
from tiermeter.sources.tables import kept

TASKS = "seq long, id string, prompt string, reference string, meta string, difficulty double"


def todo(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks without a decision yet."""
    return tasks.join(done.select(F.col("task_id").alias("id")), "id", "left_anti")


#: Decisions of a run that one window task orders.
STRETCH = 1 << 20


def failure_streak(decisions: DataFrame) -> DataFrame:
    """The longest run of failed decisions in order, for each run that has any.

    A run is cut into stretches of its sequence numbers. Each gives its longest
    streak, and those at its two ends, which the few rows of stretches then join.
    """
    d = decisions.select("run_id", "seq", F.col("error").isNotNull().alias("bad"), F.floor(F.col("seq") / STRETCH).alias("part"))
    by = Window.partitionBy("run_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("island", F.sum((~F.col("bad")).cast("int")).over(by))
    islands = d.groupBy("run_id", "part", "island").agg(F.count_if("bad").alias("n"), F.count_if(~F.col("bad")).alias("good"))
    ends = islands.groupBy("run_id", "part").agg(F.max("n").alias("longest"), F.sum("good").alias("good"), F.sum("n").alias("bad"), F.max(F.when(F.col("island") == 0, F.col("n"))).alias("head"), F.max_by("n", "island").alias("tail"))
    rows = F.sort_array(F.collect_list(F.struct("part", "longest", "good", "bad", F.coalesce("head", F.lit(0)).alias("head"), "tail")))  # a row for STRETCH decisions
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        joined = acc["open"] + F.when(x["good"] == 0, x["bad"]).otherwise(x["head"])
        return F.struct(F.greatest(acc["best"], joined, x["longest"]).alias("best"), F.when(x["good"] == 0, joined).otherwise(x["tail"]).alias("open"))

    return ends.groupBy("run_id").agg(rows.alias("rows")).select("run_id", F.aggregate("rows", start, step, lambda acc: acc["best"]).alias("streak")).where("streak > 0")


def counted(decisions: DataFrame) -> dict:
    return decisions.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("escalated").alias("escalated"), F.sum("cost_usd").alias("cost"), F.sum("audit_cost_usd").alias("audit_cost")).first().asDict()


@dataclass
class Limits:
    """When to stop: spent money, or so many failures on end. Both are looked at between micro-batches."""

    budget_usd: float | None = None
    failures: int | None = None


class Stopped(Exception):
    """A limit was reached; the reason is the message."""


class Runner:
    """Routes each micro-batch of new tasks and appends its decisions to the log."""

    def __init__(self, ledger: Ledger, tiers: Sequence[Tier], run_id: str, mode: str = "serve", audit: AuditPolicy | None = None, limits: Limits | None = None, on_batch: Callable[[dict], None] | None = None):
        self.ledger, self.tiers, self.run_id, self.mode = ledger, tiers, run_id, mode
        self.audit, self.limits, self.on_batch = audit, limits or Limits(), on_batch
        self.streak = 0
        self.spent: dict | None = None
        self.stopped: str | None = None
        ledger.start_run(run_id, {"tiers": [t.name for t in tiers]}, mode)

    def process(self, tasks: DataFrame, batch: int = 0) -> None:
        """One micro-batch; tasks that the log has already, and repeated ones, are left out, so a batch may come twice."""
        self._check()
        tasks = tasks.withColumn("__nth", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("__nth = 1").drop("__nth")
        new = todo(tasks, self.ledger.done_of(self.run_id, tasks))
        if new.isEmpty():
            return
        made = kept(route(new, self.tiers, self.run_id, self.mode, self.audit), "batch")
        self.ledger.record(made)
        self._add(made)
        if self.on_batch:
            self.on_batch(dict(self.spent))

    def counters(self) -> dict:
        """Of the whole log; one scan."""
        return counted(self.ledger.decisions(self.run_id))

    def _add(self, made: DataFrame) -> None:
        """What a batch adds: money spent, and failures on end."""
        new = counted(made)
        for k, v in new.items():
            self.spent[k] = (self.spent[k] or 0) + (v or 0)
        good = made.where("error is null").agg(F.max("seq").alias("s")).first().s
        failed = made.where(F.col("error").isNotNull())
        self.streak = self.streak + failed.count() if good is None else failed.where(F.col("seq") > good).count()

    def _check(self) -> None:
        """Limits, from counts that run along; the log is read once, when a run is taken up."""
        if self.spent is None:
            self.spent = self.counters()
            d = self.ledger.decisions(self.run_id)
            good = d.where("error is null").agg(F.max("seq").alias("s")).first().s if self.spent["failed"] else None
            self.streak = d.where((F.col("seq") > (good if good is not None else -1)) & F.col("error").isNotNull()).count() if self.spent["failed"] else 0
        if self.limits.budget_usd is not None and (self.spent["cost"] or 0) + (self.spent["audit_cost"] or 0) >= self.limits.budget_usd:
            self.stopped = "budget"
        if self.limits.failures is not None and self.streak >= self.limits.failures > 0:
            self.stopped = "failures"
        if self.stopped:
            raise Stopped(self.stopped)

    def interrupt(self) -> None:
        """Stop before the next micro-batch; what is under way is finished and recorded."""
        self.stopped = self.stopped or "interrupted"

    @contextmanager
    def interruptible(self) -> Iterator[None]:
        """The first interrupt signal lets the micro-batch end; a second one breaks off."""
        before = signal.getsignal(signal.SIGINT)

        def on_signal(number: int, frame: object) -> None:
            if self.stopped == "interrupted":
                raise KeyboardInterrupt
            self.interrupt()

        signal.signal(signal.SIGINT, on_signal)
        try:
            yield
        finally:
            signal.signal(signal.SIGINT, before)

    def stream(self, spark: SparkSession, source: str, checkpoint: str, files: int = 10):
        """Start a query over JSON files of tasks below ``source``; all there is, then it ends."""
        tasks = spark.readStream.schema(TASKS).option("maxFilesPerTrigger", files).json(source)
        return tasks.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def finish_audits(self, **options) -> int:
        """Do the pending audits of a deferred run; how many."""
        pending = self.ledger.pending_audits(self.run_id)
        n = pending.count()
        if n:
            self.ledger.record(complete_audits(pending, self.tiers[-1], **options))
        return n


def live_estimate(decisions: DataFrame, final: str, level: float = 0.95) -> Estimate:
    """The weighted disagreement of what the log has so far."""
    sums = weighted_cases(cases(decisions, final)).agg(*weighted_sums(F.col("disagree"), F.col("weight"))).first().asDict()
    return weighted_proportion(add_sums([sums]), level, finite=True)


def windowed_disagreement(cases_stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Disagreement by event-time window: an extension, since all audit sums can be merged.

    ``cases_stream``: ``ts``, ``weight``, ``disagree``.
    """
    w = F.col("weight")
    return cases_stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("window")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), (F.sum(F.when(F.col("disagree"), w).otherwise(0.0)) / F.sum(w)).alias("disagreement"))
