import json

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tiermeter.operators import audit, calibrate, judging, sweep
from tiermeter.operators.cascade import AuditPolicy, Tier, route
from tiermeter.operators.simulate import Answerer, wrong_options
from tiermeter.plans.adapters import decisions
from tiermeter.sources import calls, tasks
from tiermeter.sources.ledger import Ledger, redacted
from tiermeter.sources.tables import kept
from tiermeter.streaming.runner import Limits, Runner, Stopped, live_estimate, windowed_disagreement


@pytest.fixture(scope="module")
def served(spark):
    return kept(decisions(spark.read.parquet(f"{SF}/events.parquet")), "decisions")


def sim(spark, n=120):
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("what is "), "id").alias("prompt"), F.col("id").cast("string").alias("reference"), F.lit(None).cast("string").alias("meta"), (F.col("id") % 6).cast("double").alias("difficulty"))


TIERS = (Tier("fast", Answerer("fast", skill=2.5), 0.6), Tier("slow", Answerer("slow", skill=7.0)))


def test_summary(spark, served):
    s = audit.summarize(served, tolerance=0.1)
    assert s.tiers == ["fast", "slow"] and s.final_tier == s.reference_tier == "slow" and s.mode == "serve"
    assert sum(s.states.values()) == s.n_skipped and s.disagreement.lo <= s.disagreement.value <= s.disagreement.hi
    assert sum(b.n_cases for b in s.bins) + (s.no_score_bin.n_cases if s.no_score_bin else 0) == s.n_skipped
    assert json.dumps(s.to_dict())
    e = audit.summarize(kept(decisions(spark.read.parquet(f"{SF}/events.parquet"), "eval"), "decisions"), tolerance=0.1)
    assert e.states.get("not-selected") is None and e.disagreement.n == e.n_audited
    assert audit.summarize(served.limit(0)).status == "no-data"
    with pytest.raises(ValueError, match="several runs"):
        audit.summarize(served.unionByName(served.withColumn("run_id", F.lit("other"))))


def test_many_probabilities_make_five_groups(spark):
    found = spark.range(1000).select(F.col("id").cast("string").alias("task_id"), F.lit(0.5).alias("score"), (0.05 + 0.01 * (F.col("id") % 60)).alias("pi"), F.lit("audited").alias("state"), (F.col("id") % 9 == 0).alias("disagree"), F.lit(None).cast("boolean").alias("wrong"), F.lit(None).cast("boolean").alias("ref_wrong"))
    t = audit.strata(found)
    assert t.select("stratum").distinct().count() == 5 and t.count() == 60
    assert audit.weighted_cases(found).where("weight is null").count() == 0


def test_sweep_points_against_direct_counting(spark):
    rows = spark.range(500).select(((F.col("id") * 37 % 101) / 100).alias("s1"), ((F.col("id") * 53 % 97) / 97).alias("s2"), (F.col("id") % 3 > 0).alias("ok1"), (F.col("id") % 4 > 0).alias("ok2"), (F.col("id") % 9 > 0).alias("ok3"), F.lit(1.0).alias("cost1"), F.when(F.col("id") != 7, 2.0).alias("cost2"), F.lit(4.0).alias("cost3"))
    g1, g2 = [0.0, 0.3, 0.6, 1.01], [0.0, 0.5, 1.01]
    plain = [r.asDict() for r in rows.collect()]
    for p in sweep.points(rows, [g1, g2]).collect():
        tier = [1 if r["s1"] >= p.t1 else 2 if r["s2"] >= p.t2 else 3 for r in plain]
        assert p.correct == sum(r[f"ok{k}"] for r, k in zip(plain, tier, strict=True)) and [p.served1, p.served2, p.served3] == [tier.count(k) for k in (1, 2, 3)]
        spent = [r["cost1"] + (r["cost2"] if k > 1 and r["cost2"] else 0) + (4 if k > 2 else 0) for r, k in zip(plain, tier, strict=True)]
        unknown = any(k > 1 and r["cost2"] is None for r, k in zip(plain, tier, strict=True))
        assert p.cost_per_task is None if unknown else p.cost_per_task == pytest.approx(sum(spent) / 500)
    assert sweep.joint_cap(2) == 141 and sweep.joint_cap(1) == 20_000
    with pytest.raises(ValueError, match="points"):
        sweep.points(rows, [[k / 200 for k in range(200)], [k / 200 for k in range(200)]])


def test_frontier_has_no_dominated_point(spark):
    t = spark.createDataFrame([(1.0, 0.5, 1), (1.0, 0.6, 2), (2.0, 0.6, 3), (3.0, 0.9, 4), (None, 1.0, 5)], "cost_per_task double, accuracy double, k int")
    assert sorted(r.k for r in sweep.frontier(t, order=["k"]).collect()) == [2, 4]


def test_isotonic_pool_and_thinning(spark):
    stack = []
    for x, k in ((0.1, 1), (0.2, 0), (0.3, 2)):
        calibrate.push(stack, [x, x, k, 2])
    assert calibrate.knots_of(stack) == [(0.1, 0.25), (0.2, 0.25), (0.3, 1.0)]
    assert len(calibrate.thin_knots([(k / 50, k / 50) for k in range(50)], 20)) == 20
    pairs = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True)], "score double, label boolean")
    assert calibrate.auroc(pairs).first().auroc == 0.75 and calibrate.auroc(pairs.where("label")).first().auroc is None


def test_cascade_modes(spark):
    inline = route(sim(spark), TIERS, "r", audit=AuditPolicy(rate=0.5)).persist()
    rows = inline.collect()
    assert len(rows) == 120 and all(len(r.attempts) == 1 + r.escalated for r in rows)
    assert {r.shadow.status for r in rows if r.shadow} == {"done", "skipped"} and all(r.shadow is None for r in rows if r.escalated)
    both = route(sim(spark), TIERS, "r", mode="eval").collect()
    assert all(len(r.attempts) == 2 and r.shadow is None and r.attempts[0].agreement for r in both)
    by = {r.task.id: r for r in rows}
    assert all(by[r.task.id].final_tier == r.final_tier and by[r.task.id].answer == r.answer for r in both)
    assert all(r.audit_cost_usd > 0 for r in both if not r.escalated)


def test_failed_final_tier_serves_the_last_good_answer(spark):
    def broken(t):
        return t.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("text", "string"), ("answer", "string"), ("score", "double"), ("cost_usd", "double"), ("latency_s", "double"))], F.lit("down").alias("error"))

    rows = route(sim(spark, 40), (TIERS[0], Tier("slow", broken)), "r").where("error is not null").collect()
    assert rows and all(r.final_tier == "fast" and r.escalated and r.cost_usd is None and "down" in r.error for r in rows)


def test_deferred_audits_equal_inline_ones(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/book")
    run = Runner(book, TIERS, "r", audit=AuditPolicy("deferred", rate=0.5))
    run.process(sim(spark))
    assert book.pending_audits("r").count() == run.finish_audits(difficulty=(F.regexp_extract("task.id", r"(\d+)", 1).cast("int") % 6).cast("double"))
    assert book.pending_audits("r").count() == 0
    inline = kept(route(sim(spark), TIERS, "r", audit=AuditPolicy(rate=0.5)), "decisions")
    key = lambda d: {r.task.id: (r.shadow and (r.shadow.status, r.shadow.agreement and r.shadow.agreement.equivalent), round(r.audit_cost_usd, 12)) for r in d.collect()}
    assert key(book.decisions("r")) == key(inline)
    assert live_estimate(book.decisions("r"), "slow").n == audit.summarize(inline).n_audited


def test_ledger(spark, tmp_path, served):
    book = Ledger(spark, f"file://{tmp_path}/book")
    book.start_run("r", {"apiKey": "x", "api_key_env": "Y", "n": {"token": None}}, "serve")
    with pytest.raises(ValueError, match="mode"):
        book.start_run("r", mode="eval")
    few = served.where("seq < 50")
    book.record(few)
    book.record(few.where("seq = 3").withColumn("seq", F.lit(900).cast("long")).withColumn("answer", F.lit("new")))
    got = {r.seq: r for r in book.decisions("r").collect()}
    assert len(got) == few.count() and got[3].answer == "new"
    assert book.has("r", "3") and not book.has("r", "zzz") and book.latest_run_id() == "r"
    assert [(r.run_id, r.n) for r in book.runs().collect()] == [("r", few.count())]
    assert json.loads(book.runs().first().config) == {"apiKey": "***", "api_key_env": "Y", "n": {"token": None}}
    assert book.done_task_ids("r").count() == few.where("error is null").count()
    book.export_jsonl(f"file://{tmp_path}/out", "r")
    other = Ledger(spark, f"file://{tmp_path}/other")
    assert other.import_jsonl(f"file://{tmp_path}/out") == few.count()
    assert {r.seq: r for r in other.decisions("r").collect()} == got
    assert redacted({"a": [{"secretValue": 1}]}) == {"a": [{"secretValue": "***"}]}


def test_runner_limits_and_repeats(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/book")
    seen = []
    run = Runner(book, TIERS, "r", limits=Limits(budget_usd=1e-9), on_batch=seen.append)
    run.process(sim(spark, 10))
    with pytest.raises(Stopped, match="budget"):
        run.process(sim(spark, 20))
    assert book.decisions("r").count() == 10 and seen[0]["total"] == 10
    again = Runner(book, TIERS, "r")
    again.process(sim(spark, 20))
    again.process(sim(spark, 20))
    assert book.decisions("r").count() == 20


def test_windowed_disagreement(spark):
    d = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 2.0d as weight, true as disagree union all select timestamp'2024-01-01 00:20:00', 6.0d, false")
    assert windowed_disagreement(d).first().disagreement == 0.25


def test_task_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"question": "q1", "answer": 3.0, "x": 1}\n\n{"id": "own", "prompt": "q2", "input": "i", "reference": null, "meta": {"a": 1, "input": "z"}}\n')
    got = {r.id: r for r in tasks.load_tasks(spark, f"file://{tmp_path}/a.jsonl").collect()}
    assert got["t0001"].reference == "3" and json.loads(got["t0001"].meta) == {"x": "1"}
    assert got["own"].prompt == "q2" and got["own"].reference is None and json.loads(got["own"].meta) == {"a": "1", "input": "i"}
    (tmp_path / "b.json").write_text('{"tasks": [{"prompt": "a"}, {"prompt": "b", "label": true}]}')
    assert [r.reference for r in tasks.load_tasks(spark, f"file://{tmp_path}/b.json").orderBy("pos").collect()] == [None, "true"]
    (tmp_path / "c.csv").write_text(" prompt ,answer,id\nx,,\n,,\ny,5,k\n")
    assert {(r.id, r.reference) for r in tasks.load_tasks(spark, f"file://{tmp_path}/c.csv").collect()} == {("t0001", None), ("k", "5")}
    for name, body in (("d.jsonl", '{"prompt": "a", "id": "x"}\n{"prompt": "b", "id": "x"}\n'), ("e.jsonl", '{"other": 1}\n'), ("f.jsonl", "nonsense\n")):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception, match="repeated id|no prompt|not a JSON"):
            tasks.load_tasks(spark, f"file://{tmp_path}/{name}").collect()
    with pytest.raises(ValueError):
        tasks.load_tasks(spark, "x.txt")
    tasks.save_tasks(tasks.load_tasks(spark, f"file://{tmp_path}/b.json"), f"file://{tmp_path}/out.jsonl")
    assert tasks.load_tasks(spark, f"file://{tmp_path}/out.jsonl").count() == 2
    with pytest.raises(ValueError, match="known"):
        tasks.make(spark, "nothing")


def test_calls(spark):
    slept, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert calls.RetryPolicy(attempts=4).run(flaky, slept.append) == "ok" and len(slept) == 2
    d = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    got = {r.prompt: r for r in calls.function_calls(d, lambda p: p.upper() if p != "bad" else 1 / 0, workers=2).collect()}
    assert got["a"].text == "A" and got["bad"].error.startswith("ZeroDivisionError")


def test_judges_monitors_and_samples(spark):
    pairs = spark.createDataFrame([(1, "q", "The cat", "cat"), (2, "q", "{target}", "dog"), (3, "q", "", "x"), (4, "q", "boom", "y")], "id long, question string, candidate string, target string")

    def ask(prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        assert "Second answer: {target}" in prompt
        return "VERDICT: NOT EQUIVALENT"

    got = {r.id: (r.equivalent, r.by) for r in judging.judged(pairs, ask, workers=2).collect()}
    assert got == {1: (True, "normalized"), 2: (False, "judge"), 3: (False, "normalized"), 4: (None, "judge")}
    scores = {r.id: r.score for r in judging.monitored(pairs, lambda p: "P(correct): 0.25", workers=2).collect()}
    assert scores == {1: 0.25, 2: 0.25, 3: None, 4: 0.25}
    one = spark.createDataFrame([(1, "p", "7")], "id long, prompt string, candidate string")
    assert judging.sampled(one, lambda p: "ANSWER: 7", 3).first().score == 1.0
    assert judging.sampled(one, lambda p: "ANSWER: 8", 3).first().score == 0.25


def test_wrong_options_are_wrong():
    for ref in ("5", "-1,000", "2.50", "B", "c", "Yes", "Paris", "0"):
        options = wrong_options(ref)
        assert options and ref not in options


def test_structure():
    from pathlib import Path

    root = Path(__file__).parents[1]
    for p in (root / "tiermeter").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tiermeter.llm" not in p.read_text()


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Spark reads larger files first; numbers follow the names of the files and their lines."""
    folder = tmp_path / "many.jsonl"
    folder.mkdir()
    want = []
    for k, n in enumerate((3, 400, 1, 60)):
        lines = [f"file {k} line {i} " + "x" * (i % 40) for i in range(n)]
        (folder / f"part-{k}.jsonl").write_text("".join(json.dumps({"prompt": t}) + "\n\n" for t in lines))
        want += lines
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (size, "4096b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = tasks.load_tasks(spark, f"file://{folder}").orderBy("pos").collect()
            assert [r.prompt for r in got] == want and [r.pos for r in got] == list(range(1, len(want) + 1)), most
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "short.csv").write_text('prompt,answer,id\nx\ny,1,k\n"say ""a, b"" or",2,q\n"p, ""q"", r"\n')
    assert {(r.id, r.prompt, r.reference) for r in tasks.load_tasks(spark, f"file://{tmp_path}/short.csv").collect()} == {("t0001", "x", None), ("k", "y", "1"), ("q", 'say "a, b" or', "2"), ("t0004", 'p, "q", r', None)}
    (tmp_path / "wide.csv").write_text("prompt,answer\nx,1\ny,1,\n")
    with pytest.raises(Exception, match="too many cells"):
        tasks.load_tasks(spark, f"file://{tmp_path}/wide.csv").collect()


def test_divisions_come_out_even_or_are_errors(spark):
    from tiermeter.functions.exprs import apply_ops

    def fold(start, *ops):
        d = spark.createDataFrame([(start, list(ops))], "start double, ops array<struct<op:string,value:double>>")
        return d.select(apply_ops(F.col("start"), F.col("ops")).alias("v")).first().v

    assert fold(7.0, ("mul", 6.0), ("div", 3.0), ("floordiv", 4.0), ("sub", 1.0)) == 2.0 and fold(-7.0, ("floordiv", 2.0)) == -4.0
    assert fold(None, ("div", 2.0)) is None and fold(3.0, ("div", None)) is None
    for ops in ([("div", 2.0)], [("div", 0.0)], [("floordiv", 0.0)]):
        with pytest.raises(Exception, match="not a whole result"):
            fold(7.0, *ops)
