"""Cells of an audit, merged and followed as a stream, against the summary of all decisions."""

import math
import shutil
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tiermeter.operators import audit, cube
from tiermeter.operators.cascade import AuditPolicy, Tier
from tiermeter.operators.simulate import Answerer
from tiermeter.plans.adapters import decisions
from tiermeter.sources.ledger import Ledger
from tiermeter.sources.tables import kept
from tiermeter.streaming.live import Follower, Progress
from tiermeter.streaming.runner import Runner

TIERS = (Tier("fast", Answerer("fast", skill=2.5), 0.6), Tier("slow", Answerer("slow", skill=7.0)))


def same(a, b, at=""):
    """Equal but for the last digits of sums."""
    if isinstance(a, dict):
        assert a.keys() == b.keys(), at
        for k in a:
            same(a[k], b[k], f"{at}.{k}")
    elif isinstance(a, list):
        assert len(a) == len(b), at
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            same(x, y, f"{at}[{k}]")
    elif isinstance(a, float) and isinstance(b, (int, float)):
        assert math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-12) or a != a and b != b, (at, a, b)
    else:
        assert a == b, (at, a, b)


@pytest.mark.parametrize("mode", ["serve", "eval"])
def test_cells_of_two_halves_give_the_summary_of_the_whole(spark, mode):
    d = kept(decisions(spark.read.parquet(f"{SF}/events.parquet"), mode), "decisions")
    whole = audit.summarize(d, 0.1)
    halves = [kept(audit.cells(d.where(F.col("seq") % 2 == k)), "cells") for k in (0, 1)]
    merged = kept(cube.merged(*halves), "cells")
    assert merged.columns == list(cube.columns()) == halves[0].columns
    same(audit.summarize_cells(merged, 0.1).to_dict(), whole.to_dict())
    assert merged.count() < d.count()


def test_cells_are_all_that_a_summary_reads(spark, tmp_path):
    d = kept(decisions(spark.read.parquet(f"{SF}/events.parquet")), "decisions")
    d.write.parquet(f"file://{tmp_path}/decisions")
    made = audit.cells(spark.read.parquet(f"file://{tmp_path}/decisions"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    made.write.parquet(f"file://{tmp_path}/cells")
    shutil.rmtree(tmp_path / "decisions")
    same(audit.summarize_cells(spark.read.parquet(f"file://{tmp_path}/cells"), 0.1).to_dict(), audit.summarize(d, 0.1).to_dict())


def test_weighted_sums_of_cells_are_those_of_cases(spark):
    d = kept(decisions(spark.read.parquet(f"{SF}/events.parquet")), "decisions")
    s = audit.summarize(d)
    direct = audit.weighted_cases(audit.cases(d, "slow")).agg(*audit.weighted_sums(F.col("disagree"), F.col("weight"))).first().asDict()
    want = audit.weighted_proportion(audit.add_sums([direct]), finite=True)
    same(s.disagreement.__dict__, want.__dict__)


def sim(spark, first, last):
    return spark.range(first, last).select(F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("what is "), "id").alias("prompt"), F.col("id").cast("string").alias("reference"), F.lit(None).cast("string").alias("meta"), (F.col("id") % 6).cast("double").alias("difficulty"))


def follow(book, tmp_path, **options):
    seen = []
    f = Follower(book, "r", f"file://{tmp_path}/follow", on_summary=lambda s, streak: seen.append((s, streak)), tolerance=0.1, **options)
    f.start().awaitTermination()
    return f, seen


def test_a_followed_run_equals_its_log(spark, tmp_path):
    """With deferred audits, by a follower that takes the stream up again, and when a trigger is done twice."""
    book = Ledger(spark, f"file://{tmp_path}/book")
    run = Runner(book, TIERS, "r", audit=AuditPolicy("deferred", rate=0.5))
    run.process(sim(spark, 0, 40))
    told = Progress()
    spark.streams.addListener(told)
    f, seen = follow(book, tmp_path)
    assert len(seen) == 1 and f.summary.states.get("pending") and not f.summary.n_audited
    same(f.summary.to_dict(), audit.summarize(book.decisions("r"), 0.1).to_dict())
    for _ in range(100):
        if told.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(told)
    assert list(told.rows.values()) == [40] and list(told.ended.values()) == [None]
    assert run.finish_audits() > 0
    f = Follower(book, "r", f"file://{tmp_path}/follow", tolerance=0.1)
    once = f._trigger
    f._trigger = lambda changed, epoch: (once(changed, epoch), once(changed, epoch))
    f.start().awaitTermination()
    assert f.summary.n_audited and not f.summary.states.get("pending")
    same(f.summary.to_dict(), audit.summarize(book.decisions("r"), 0.1).to_dict())


def test_streaks_and_decisions_made_again(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/book")
    book.start_run("r")
    d = decisions(spark.read.parquet(f"{SF}/events.parquet")).where("seq < 60").withColumn("run_id", F.lit("r")).withColumn("error", F.when(F.col("seq").isin(20, 57, 58, 59), "down"))
    book.record(d)
    f, _ = follow(book, tmp_path)
    assert f.streak == 3 and f.summary.n_errors == 4
    book.record(d.where("seq in (20, 58)").withColumn("error", F.lit(None).cast("string")))
    f, _ = follow(book, tmp_path)
    assert f.streak == 1 and f.summary.n_errors == 2
    same(f.summary.to_dict(), audit.summarize(book.decisions("r"), 0.1).to_dict())
