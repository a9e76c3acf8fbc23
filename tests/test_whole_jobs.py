"""Queries whose SQL, if any, can't show that they do the whole job."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tiermeter.functions import text
from tiermeter.operators import audit, sweep
from tiermeter.operators.matching import longest_contained
from tiermeter.plans import all_queries, curve_queries, scalar_queries
from tiermeter.plans.adapters import decisions
from tiermeter.schema import ATTEMPT, COMPLETION, struct_of
from tiermeter.sources.tables import kept
from tiermeter.plans.scalar_queries import said, sim_tasks


def test_contains_compares_every_reply(spark):
    same = text.comparator("contains")
    want = sorted((r.conv_id, r.turn, same(r.reply, "the")) for r in said(spark, SF).collect())
    assert sorted(map(tuple, all_queries()["contains_cmp"](spark, SF).collect())) == want


def test_simulated_prompts_are_whole(spark):
    want = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted((r.seq, r.prompt) for r in sim_tasks(spark, SF).collect()) == want and max(len(t) for _, t in want) > 80


def test_short_prompts_are_found(spark):
    prompts = ["", None, "a", "cat", "the cat", "Where is the cat that sat on the mat", "dog", "cat"]
    requests = ["xx", "a", "cat", "So the cat", "Please: Where is the cat that sat on the mat?", "do g", "", None]
    t = spark.createDataFrame(list(enumerate(prompts)), "task_id long, prompt string")
    r = spark.createDataFrame(list(enumerate(requests)), "request_id long, request string")
    want = [(i, max((len(p), k) for k, p in enumerate(prompts) if p and p in q)[1]) for i, q in enumerate(requests) if q and any(p and p in q for p in prompts)]
    assert sorted(map(tuple, longest_contained(r, t).collect())) == want
    assert longest_contained(r, t.where("prompt = ''")).count() == 0


def test_coverage_takes_all_seeds(spark, monkeypatch):
    seeds = []
    redraw = curve_queries.montecarlo.redraw
    monkeypatch.setattr(curve_queries.montecarlo, "redraw", lambda cases, n: seeds.append(n) or redraw(cases, 2))
    all_queries()["coverage_full"](spark, SF)
    assert seeds == [5000]


def test_conditions_on_items_dont_bring_copies_of_the_attempts(spark):
    rows = curve_queries.flat(spark, SF).where("cost1 is not null and s1 > 0.5 and ok1")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1


def test_items_take_tiers_in_any_order_and_only_whole_decisions(spark):
    def attempt(tier, there=True):
        return struct_of(ATTEMPT, tier=F.lit(tier), completion=struct_of(COMPLETION, text=F.lit(tier), cost_usd=F.lit(float(len(tier)))) if there else F.lit(None))

    a, bb = attempt("a"), attempt("bb")
    kinds = {"in order": [a, bb], "turned": [bb, a], "twice": [a, a], "one": [a], "three": [a, bb, a], "no answer": [a, attempt("bb", False)]}
    parts = [spark.range(1).select(F.struct(F.lit(k).alias("id")).alias("task"), F.array(*v).alias("attempts"), F.lit(None).cast("string").alias("error")) for k, v in kinds.items()]
    d = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]).union(parts[5])
    d = d.union(parts[0].withColumn("error", F.lit("failed"))).union(parts[0].withColumn("attempts", F.lit(None).cast(f"array<{ATTEMPT}>")))
    got = sorted((r.task_id, r.base1, r.base2) for r in sweep.items(d, ["a", "bb"]).collect())
    assert got == [("in order", 1.0, 2.0), ("turned", 1.0, 2.0), ("twice", 1.0, None)]


@pytest.mark.parametrize("strata", [5, 300])
def test_redraws_are_those_of_the_hash_and_no_case_is_exploded(spark, strata):
    pi = F.element_at(F.array(*map(F.lit, (0.1, 0.5, 1.0, None, 0.0))), (F.col("id") % 5 + 1).cast("int")) if strata == 5 else (F.col("id") % strata + 1) / F.lit(float(strata))
    cases = spark.range(3000).select(F.col("id").cast("string").alias("task_id"), pi.alias("pi"), F.when(F.col("id") % 7 > 0, F.col("id") % 3 == 0).alias("disagree"))
    u = F.shiftrightunsigned(F.xxhash64("task_id", "seed"), 11) / F.lit(float(1 << 53))
    want = cases.withColumn("seed", F.explode(F.sequence(F.lit(-2), F.lit(37)))).where(u < F.col("pi")).groupBy("seed", "pi").agg(F.count("*").alias("drawn"), F.count_if("disagree").alias("hits"))
    got = curve_queries.montecarlo.redraw(cases, 40, -2)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_streamed_tasks_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scalar_queries, "shared_dir", lambda _: f"file://{tmp_path}")
    got, want = (all_queries()["streaming_resume"](spark, d).first() for d in (str(tmp_path), SF))
    assert got == want
    assert len(list(tmp_path.glob("stream-*/in/a/part-*.json"))) > 2


def test_rows_of_cells_are_made_once(spark):
    run = kept(decisions(spark.read.parquet(f"{SF}/events.parquet")), "decisions")
    plan = audit.cells(run)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambda" in line for line in plan.splitlines() if "Filter (" in line)
