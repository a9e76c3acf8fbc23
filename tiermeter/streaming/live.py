"""An audit that follows the decision log as a stream, and keeps its sums instead of reading the log again.

The state of the stream is one small row for each task: what its current decision
puts into the audit's cells. A decision that is recorded again (a deferred audit
that is done, a failed task that was tried again) gives that row with the sign -1
and its new one with +1. Each trigger sums those changes to cells, adds them to the
cells of the trigger before, and finishes a summary from them. Cells, not
decisions, are what a trigger reads; both they and the state are at the checkpoint, so
a stream taken up again goes on where it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tiermeter.operators import cube
from tiermeter.operators.audit import EDGES, Summary, bin_of, summarize_cells
from tiermeter.schema import DECISION
from tiermeter.sources.ledger import Ledger
from tiermeter.sources.tables import exists, remove

CHANGE = "run_id string, task_id string, seq long, failed boolean, sign int, row string"
STATE = "batch long, seq long, failed boolean, row string"
#: Epochs of cells that are kept: the current one, and that which a repeated trigger starts from.
KEPT_EPOCHS = 2


def changes(decisions: DataFrame, edges: Sequence[float] = EDGES) -> DataFrame:
    """Rows put into cells and taken off them (``CHANGE``), from a stream of decisions with their ``batch``."""
    rows = cube.rows(decisions.withColumn("__id", F.col("task.id")), bin_of(F.col("score"), edges), "run_id", "__id", "seq", "batch", F.col("error").isNotNull().alias("failed"))
    flat = rows.select("run_id", F.col("__id").alias("task_id"), "seq", "batch", "failed", F.to_json("rows").alias("row"))
    return flat.groupBy("run_id", "task_id").applyInPandasWithState(_replace, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def _replace(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of a task's decisions takes the place, and the sequence number, of the one before."""
    new = max((r for f in frames for r in zip(f["batch"], f["seq"], f["failed"], f["row"], strict=True)), key=lambda r: r[:2])
    old = state.get if state.exists else None
    if old is not None and new[0] <= old[0]:
        return
    seq = int(old[1]) if old is not None else int(new[1])
    out = [(*key, seq, bool(old[2]), -1, old[3])] if old is not None else []
    state.update((int(new[0]), seq, bool(new[2]), new[3]))
    yield pd.DataFrame([*out, (*key, seq, bool(new[2]), 1, new[3])], columns=["run_id", "task_id", "seq", "failed", "sign", "row"])


def cells_of(changed: DataFrame) -> DataFrame:
    """The cells of a batch of changes; sums of what was taken off are negative."""
    rows = changed.select("sign", F.explode(F.from_json("row", f"array<struct<{_ddl(cube.ROW)}>>")).alias("r")).select("sign", "r.*")
    return cube.summed(rows, F.col("sign"))


def _ddl(columns: str) -> str:
    """Columns of a DDL string as the fields of a struct type."""
    return ",".join(re.sub(r"^(\w+) ", r"\1:", c) for c in columns.split(", "))


class Follower:
    """Keeps a run's cells and failure streak up to date from the log's stream."""

    def __init__(self, ledger: Ledger, run_id: str, checkpoint: str, on_summary: Callable[[Summary, int], None] | None = None, tolerance: float | None = None, level: float = 0.95, edges: Sequence[float] = EDGES):
        self.ledger, self.run_id, self.checkpoint = ledger, run_id, checkpoint.rstrip("/")
        self.on_summary, self.tolerance, self.level, self.edges = on_summary, tolerance, level, edges
        self.summary: Summary | None = None
        self.streak = 0

    def start(self, **trigger) -> StreamingQuery:
        """Follow the run's files; ``trigger`` as ``DataStreamWriter.trigger`` takes it (default: all there is, then end)."""
        spark: SparkSession = self.ledger.spark
        log = spark.readStream.schema(f"{DECISION}, batch long").parquet(f"{self.ledger.path}/decisions").where(F.col("run_id") == self.run_id)
        out = changes(log, self.edges).writeStream.outputMode("append").foreachBatch(self._trigger).option("checkpointLocation", f"{self.checkpoint}/stream")
        return out.trigger(**(trigger or {"availableNow": True})).start()

    def _at(self, what: str, epoch: int) -> str:
        return f"{self.checkpoint}/{what}/epoch={epoch}"

    def _before(self, epoch: int) -> int | None:
        return next((e for e in range(epoch - 1, max(-1, epoch - 1 - KEPT_EPOCHS), -1) if exists(self.ledger.spark, f"{self._at('tail', e)}/_SUCCESS")), None)

    def _trigger(self, changed: DataFrame, epoch: int) -> None:
        """Add one trigger's changes to the cells before; done again for the same epoch, it gives the same."""
        spark = self.ledger.spark
        here = f"{self.checkpoint}/changes"
        changed.write.mode("overwrite").parquet(here)
        changed = spark.read.schema(CHANGE).parquet(here)
        before = self._before(epoch)
        parts = [cells_of(changed)] + ([spark.read.parquet(self._at("cells", before))] if before is not None else [])
        cube.merged(*parts).write.mode("overwrite").parquet(self._at("cells", epoch))
        self._tail(changed, before, epoch)
        for old in (epoch - KEPT_EPOCHS - k for k in range(2)):
            for what in ("cells", "tail"):
                remove(spark, self._at(what, old))
        self._finish(epoch)

    def _tail(self, changed: DataFrame, before: int | None, epoch: int) -> None:
        """The last good decision (a row that isn't ``failed``) and the failed ones after it: what a streak is counted from.

        A decision that failed first and is good now is no longer among them; one that was good stays good.
        """
        last = changed.where("sign = 1").select("seq", "failed")
        if before is not None:
            old = self.ledger.spark.read.parquet(self._at("tail", before))
            last = last.unionByName(old.join(last.select("seq"), "seq", "left_anti"))
        good = last.agg(F.max(F.when(~F.col("failed"), F.col("seq"))).alias("good"))
        kept = last.crossJoin(F.broadcast(good)).where("good is null or seq >= good").where("failed or seq = good")  # good has one row
        kept.select("seq", "failed").write.mode("overwrite").parquet(self._at("tail", epoch))

    def _finish(self, epoch: int) -> None:
        spark = self.ledger.spark
        self.streak = spark.read.parquet(self._at("tail", epoch)).where("failed").count()
        self.summary = summarize_cells(spark.read.parquet(self._at("cells", epoch)), self.tolerance, self.level, self.edges)
        if self.on_summary:
            self.on_summary(self.summary, self.streak)


class Progress(StreamingQueryListener):
    """Counts what streams have read, by query name or id, and tells ``on_progress``."""

    def __init__(self, on_progress: Callable[[str, int, float], None] | None = None):
        self.on_progress = on_progress
        self.rows: dict[str, int] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  named by Spark
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        if self.on_progress:
            self.on_progress(name, self.rows[name], p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception
