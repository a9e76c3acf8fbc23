"""Commands over a ledger: init, run, audit, sweep, calibrate, report, runs, export, import, datasets, demo."""

from __future__ import annotations

import argparse
import json
import math
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tiermeter import config, report
from tiermeter.operators import audit, calibrate, sweep
from tiermeter.sources import tasks
from tiermeter.sources.ledger import Ledger
from tiermeter.streaming.runner import Limits, Runner, Stopped

# Exit codes.
OK, FAILED, USAGE, BREACH, STOPPED, INTERRUPTED = 0, 1, 2, 3, 4, 130
#: Runs that a message about an unknown one names, at most.
RECENT = 5
DEMO = {"tiers": [{"name": "fast", "backend": "simulated", "threshold": 0.7, "options": {"skill": 3.0}}, {"name": "slow", "backend": "simulated", "options": {"skill": 7.0, "input_price": 5.0, "output_price": 25.0}}], "audit": {"rate": 0.3, "tolerance": 0.1}}

STARTER = """\
# Where decisions go: a folder that all machines share.
ledger = "ledger"

[run]
id = "first"
mode = "serve"  # eval asks every tier about every task

[[tiers]]
name = "fast"
backend = "simulated"
threshold = 0.7  # answers with at least this confidence are served
[tiers.options]
skill = 3.0

[[tiers]]
name = "slow"  # the last tier has no threshold
backend = "simulated"
[tiers.options]
skill = 7.0
input_price = 5.0
output_price = 25.0

[audit]
rate = 0.1  # share of the served cases that the last tier answers again
tolerance = 0.05
"""


def plain(v):
    """JSON without NaN and infinities."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def show(value) -> None:
    print(json.dumps(plain(value), indent=2, default=str))


def _run(spark, a, c: config.Config, work) -> int:
    book = Ledger(spark, a.ledger or c.ledger)
    runner = Runner(book, c.tiers, a.run or c.run_id, a.mode or c.mode, c.audit, Limits(a.budget, a.failures))
    try:
        with runner.interruptible():
            runner.process(work)
            runner.finish_audits()
    except Stopped as e:
        print(f"stopped: {e}", file=sys.stderr)
        return STOPPED
    counters = runner.counters()
    show(counters)
    return FAILED if counters["total"] and counters["failed"] == counters["total"] else OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tiermeter", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *options, ledger=True):
        q = sub.add_parser(name)
        if ledger:
            q.add_argument("--ledger", default=None)
            q.add_argument("--run", default=None)
        for o, kw in options:
            q.add_argument(o, **kw)

    number = {"type": float, "default": None}
    limits = [("--budget", number), ("--failures", {"type": int, "default": None}), ("--mode", {"choices": ["serve", "eval"], "default": None})]
    add("init", ("path", {"nargs": "?", "default": "tiermeter.toml"}), ("--force", {"action": "store_true"}), ledger=False)
    add("run", ("config", {}), ("tasks", {}), ("--limit", {"type": int, "default": None}), *limits)
    add("demo", ("--n", {"type": int, "default": 400}), *limits)
    add("audit", ("--tolerance", number), ("--level", {"type": float, "default": 0.95}), ("--json", {"action": "store_true"}))
    add("report", ("path", {}), ("--tolerance", number))
    add("sweep", ("--target", number), ("--objective", {"default": "max-savings"}), ("--holdout", {"type": float, "default": 0.3}), ("--most", {"type": int, "default": 101}))
    add("calibrate", ("--tier", {"default": None}), ("--knots", {"type": int, "default": 20}))
    add("runs")
    add("export", ("path", {}))
    add("import", ("path", {}))
    add("datasets", ("path", {}), ledger=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            return _init(a.path, a.force)
        return _command(spark or SparkSession.builder.appName("tiermeter").getOrCreate(), a)
    except (config.ConfigError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        print("interrupted; run the same command again to go on", file=sys.stderr)
        return INTERRUPTED


def _init(path: str, force: bool) -> int:
    """A configuration to start from; a file that is there stays unless forced."""
    if os.path.exists(path) and not force:
        raise ValueError(f"{path} is there already; --force replaces it")
    with open(path, "w", encoding="utf-8") as f:
        f.write(STARTER)
    print(path)
    return OK


def _which_run(book: Ledger, wanted: str | None) -> tuple[str, str]:
    """The run asked for, or the latest one, and its mode."""
    known = {r.run_id: r.mode for r in book.runs().collect()}  # a row for each run, oldest first
    if not known:
        raise ValueError("the ledger has no runs")
    if wanted is not None and wanted not in known:
        raise ValueError(f"no run {wanted}; the last ones are {', '.join(list(known)[-RECENT:])}")
    run = wanted or book.latest_run_id()
    return run, known[run]


def _command(spark: SparkSession, a) -> int:
    if a.command == "run":
        work = tasks.load_tasks(spark, a.tasks, a.limit)
        level = F.get_json_object("meta", "$.difficulty").try_cast("double")
        return _run(spark, a, config.load(a.config), work.select(F.col("pos").alias("seq"), "id", "prompt", "reference", "meta", F.coalesce(level, F.lit(2.0)).alias("difficulty")))
    if a.command == "demo":
        work = tasks.arithmetic(spark, a.n)
        return _run(spark, a, config.parse(DEMO), work.select(F.col("pos").alias("seq"), "id", "prompt", "reference", F.lit(None).cast("string").alias("meta"), F.col("steps").cast("double").alias("difficulty")))
    if a.command == "datasets":
        t = tasks.load_tasks(spark, a.path)
        levels = tasks.levels(t).collect()  # a row for each level
        show({"tasks": sum(r.tasks for r in levels), "with_reference": sum(r.with_reference for r in levels), "levels": {r.level: r.tasks for r in levels}})
        return OK
    book = Ledger(spark, a.ledger or "ledger")
    if a.command == "runs":
        for r in book.runs().collect():
            print(f"{r.run_id}\t{r.created_at}\t{r.mode}\t{r.n}")
        return OK
    if a.command == "import":
        print(book.import_jsonl(a.path))
        return OK
    run, mode = _which_run(book, a.run)
    if a.command == "export":
        book.export_jsonl(a.path, run)
        return OK
    decisions = book.decisions(run)
    if a.command == "audit":
        s = audit.summarize(decisions, a.tolerance, a.level)
        show(s.to_dict()) if a.json else print(report.as_text(s))
        return BREACH if s.status == "breach" else OK
    if a.command == "report":
        s = audit.summarize(decisions, a.tolerance)
        report.write_report(s, a.path, report.eval_sections(decisions, s.tiers) if mode == "eval" else ())
        return OK
    tiers, _ = audit.tier_order(decisions)
    if a.command == "sweep":
        sweep.check_runs(decisions)
        rows = sweep.items(decisions, tiers)
        most = min(a.most, sweep.joint_cap(len(tiers) - 1) - 2)
        grids = [sweep.default_grid(rows, f"s{j}", most) for j in range(1, len(tiers))]
        show({"recommendation": sweep.recommend(rows, grids, a.objective, a.target, a.holdout), "baselines": [r.asDict() for r in sweep.baselines(rows, tiers).collect()], "oracle": sweep.oracle(rows, len(tiers)).first().asDict()})
        return OK
    tier = a.tier or tiers[0]
    at = F.get(F.filter("attempts", lambda x: x["tier"] == F.lit(tier)), F.lit(0))
    pairs = decisions.select(F.col("task.id").alias("event_id"), at["confidence"]["score"].alias("score"), F.coalesce(at["correct"]["equivalent"], at["agreement"]["equivalent"]).alias("label"), at["error"].alias("error"))
    pairs = pairs.where("error is null and score is not null and not isnan(score) and label is not null")
    show(calibrate.cross_fitted(pairs) | {"tier": tier, "measures": calibrate.measures(pairs), "points": calibrate.thin_knots(calibrate.fit_isotonic(pairs), a.knots)})
    return OK


if __name__ == "__main__":
    sys.exit(main())
