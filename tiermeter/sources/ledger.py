"""The decision log: an append-only Parquet table that keeps a run's place and its last word.

Each write appends a batch with a rising number. A decision recorded again
replaces the earlier one when read, in the earlier one's place. Files of a run
lie in its own folder, so a read of one run touches no other.
"""

from __future__ import annotations

import json
import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermeter.schema import DECISION
from tiermeter.sources.tables import exists

SECRET = re.compile(r"(?:^|_)(?:key|token|secret|password|passwd|credential|authorization)s?(?:_|$)")
#: Of the tables' layout. Version 1 had no ``error`` column; it reads as null.
VERSION = 2
RUNS = "run_id string, created_at string, mode string, config string, note string, version long"


def redacted(config):
    """A configuration without its secrets; names of environment variables stay."""
    if isinstance(config, dict):
        out = {}
        for k, v in config.items():
            words = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", str(k)).lower())
            hidden = SECRET.search(words) and not words.endswith("_env") and v is not None
            out[k] = "***" if hidden else redacted(v)
        return out
    return [redacted(v) for v in config] if isinstance(config, (list, tuple)) else config


def differences(a, b, at: str = "") -> list[str]:
    """Dotted paths at which two configurations differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted({*a, *b}) for d in differences(a.get(k), b.get(k), f"{at}.{k}" if at else k)]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [d for k, (x, y) in enumerate(zip(a, b, strict=True)) for d in differences(x, y, f"{at}[{k}]")]
    return [] if a == b else [at]


def upserted(log: DataFrame, keys: list[str], version: str, position: str) -> DataFrame:
    """The last version of each key, in the place of its first."""
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(F.col(version).desc(), F.col(position).desc()))
    return log.withColumn("__last", last).withColumn("__place", F.min(position).over(w)).where("__last = 1").drop("__last").withColumn(position, F.col("__place")).drop("__place")


class Ledger:
    """Runs and their decisions below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.migrate()

    def migrate(self) -> int:
        """The version found. An older ledger is marked as of this one; a newer one is an error."""
        where = f"{self.path}/meta"
        if exists(self.spark, where):
            found = self.spark.read.schema("version int").parquet(where).agg(F.max("version").alias("v")).first().v or 1
        else:
            found = 1 if exists(self.spark, f"{self.path}/decisions") else 0
        if found > VERSION:
            raise ValueError(f"{self.path} has version {found} of the ledger; this library reads up to {VERSION}")
        if found < VERSION:
            self.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("append").parquet(where)
        return found

    def drift(self, run_id: str, config: dict) -> list[str]:
        """Where a run's configuration differs from ``config``, as dotted paths."""
        old = self._runs().where(F.col("run_id") == run_id).orderBy(F.desc("version")).first()
        return differences(json.loads(old.config or "{}"), json.loads(json.dumps(redacted(config)))) if old else []

    def _log(self) -> DataFrame:
        where = f"{self.path}/decisions"
        schema = f"{DECISION}, batch long"
        return self.spark.read.schema(schema).parquet(where) if exists(self.spark, where) else self.spark.createDataFrame([], schema)

    def _runs(self) -> DataFrame:
        where = f"{self.path}/runs"
        return self.spark.read.schema(RUNS).parquet(where) if exists(self.spark, where) else self.spark.createDataFrame([], RUNS)

    def start_run(self, run_id: str, config: dict | None = None, mode: str = "serve", note: str = "") -> None:
        """Register a run; again for the same run it refreshes its configuration and note, but not its mode."""
        old = self._runs().where(F.col("run_id") == run_id).orderBy(F.desc("version")).first()
        if old and old.mode != mode:
            raise ValueError(f"run {run_id} has mode {old.mode}, not {mode}")
        created = old.created_at if old else datetime.now(UTC).isoformat()
        version = (self._runs().agg(F.max("version").alias("v")).first().v or 0) + 1
        row = [(run_id, created, mode, json.dumps(redacted(config or {}), sort_keys=True), note, version)]
        self.spark.createDataFrame(row, RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def record(self, decisions: DataFrame) -> int:
        """Append decisions as one batch; its number, which rises with time whoever writes."""
        batch = time.time_ns()
        decisions.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/decisions")
        return batch

    def decisions(self, run_id: str | None = None) -> DataFrame:
        """The current decisions of a run (the latest one by default); order by ``seq`` for insertion order."""
        run_id = run_id or self.latest_run_id()
        own = self._log().where(F.col("run_id") == run_id).withColumn("__key", F.col("task.id"))
        return upserted(own, ["__key"], "batch", "seq").drop("__key", "batch")

    def pending_audits(self, run_id: str) -> DataFrame:
        return self.decisions(run_id).where(F.col("shadow.status") == "pending")

    def done_task_ids(self, run_id: str, include_errors: bool = False) -> DataFrame:
        d = self.decisions(run_id)
        return (d if include_errors else d.where("error is null")).select(F.col("task.id").alias("task_id"))

    def done_of(self, run_id: str, ids: DataFrame) -> DataFrame:
        """Which of ``ids`` (``id``, one micro-batch) have a decision without error; only ids and errors of the run are read."""
        good = self._log().where((F.col("run_id") == run_id) & F.col("error").isNull()).select(F.col("task.id").alias("id"))
        return good.join(ids.select("id"), "id", "left_semi").distinct().select(F.col("id").alias("task_id"))  # Spark broadcasts the ids if they are few

    def has(self, run_id: str, task_id: str) -> bool:
        return not self._log().where((F.col("run_id") == run_id) & (F.col("task.id") == task_id)).limit(1).isEmpty()

    def runs(self) -> DataFrame:
        """Runs, oldest first, with the number of their decisions."""
        last = upserted(self._runs(), ["run_id"], "version", "version")
        n = self._log().groupBy("run_id").agg(F.count_distinct("task.id").alias("n"))
        return last.join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("created_at", "version")

    def latest_run_id(self) -> str | None:
        first = self._runs().groupBy("run_id").agg(F.min("created_at").alias("created_at"), F.min("version").alias("version"))
        return first.agg(F.max_by("run_id", F.struct("created_at", "version")).alias("r")).first().r

    def export_jsonl(self, path: str, run_id: str | None = None) -> None:
        """A header line with the run, then its decisions in order, in ordered part files."""
        run_id = run_id or self.latest_run_id()
        head = self.runs().where(F.col("run_id") == run_id).select(F.lit(-1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("run").alias("kind"), "run_id", "created_at", "mode", "config", "note")).alias("value"))
        rows = self.decisions(run_id)
        rows = rows.select("seq", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))
        head.unionByName(rows).orderBy("seq").select("value").write.text(path)

    def import_jsonl(self, path: str) -> int:
        """Check all lines, then take over the runs and their decisions; how many decisions."""
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        kind = F.get_json_object("value", "$.kind")
        heads = lines.where(kind == "run").select(F.from_json("value", "run_id string, created_at string, mode string, config string, note string").alias("r")).select("r.*").collect()  # a line for each run
        known = {r.run_id: r.mode for r in self.runs().collect()}
        for h in heads:
            if known.get(h.run_id, h.mode) != h.mode:
                raise ValueError(f"run {h.run_id} has mode {known[h.run_id]}, not {h.mode}")
        rows = lines.where(kind.isNull()).select(F.from_json("value", DECISION, {"mode": "FAILFAST"}).alias("d")).select("d.*")
        n = rows.count()
        for h in heads:
            self.start_run(h.run_id, json.loads(h.config or "{}"), h.mode, h.note or "")
        if n:
            self.record(rows)
        return n
