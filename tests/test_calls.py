"""Calls under way side by side, and what is kept of them."""

import time

import pytest
from pyspark.sql import functions as F

from tiermeter.sources import calls


def test_calls_run_side_by_side(spark):
    """1,000 calls of 0.1 s in 4 tasks with 8 under way: 3.2 s of waiting instead of 25."""
    d = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("prompt"))
    calls.function_calls(d.limit(8), lambda p: p, workers=4).count()
    began = time.perf_counter()
    got = calls.function_calls(d, lambda p: time.sleep(0.1) or p.upper(), workers=4, flight=8).collect()
    assert time.perf_counter() - began < 6
    assert sorted(r.text for r in got) == sorted(f"P{k}" for k in range(1000)) and all(r.latency_s >= 0.1 for r in got)


def test_results_keep_their_rows_and_no_more_than_that_are_under_way():
    import threading

    under_way, most = 0, 0
    lock = threading.Lock()

    def f(p):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.01 * (int(p) % 3))
        with lock:
            under_way -= 1
        if p == "7":
            raise ValueError("no")
        return f"<{p}>"

    kept = []
    prompts = [str(k) for k in range(40)]
    rows = list(calls.in_flight(prompts, prompts, f, calls.RetryPolicy(1), 5, {"3": ("had", None, 1, 1, 0.0)}, lambda k, r: kept.append(k)))
    assert most == 5 and [r[0] for r in rows] == ["had" if p == "3" else None if p == "7" else f"<{p}>" for p in prompts]
    assert rows[7][1] == "ValueError: no" and sorted(kept, key=int) == [p for p in prompts if p not in ("3", "7")]


def test_a_task_run_again_repeats_only_what_it_had_not_finished(tmp_path):
    """A task that ends half way: its finished calls are found in the log by the one that follows."""

    class Gone(BaseException):
        """Ends the task, as a lost executor does; it isn't a failure of the call."""

    made, gone = [], []

    def f(prompt):
        made.append(prompt)
        if prompt == "p13" and not gone:
            time.sleep(0.2)
            gone.append(prompt)
            raise Gone
        return prompt.upper()

    prompts, log = [f"p{k}" for k in range(60)], calls.CallLog(f"file://{tmp_path}/log")
    with pytest.raises(Gone):
        list(calls.in_flight(prompts, prompts, f, calls.RetryPolicy(1), 3, log.load(4), log.keeper(4)))
    finished = log.load(4)
    assert 12 <= len(finished) < 60 and "p13" not in finished and log.load(5) == {}
    before = len(made)
    rows = list(calls.in_flight(prompts, prompts, f, calls.RetryPolicy(1), 3, finished, log.keeper(4)))
    assert [r[0] for r in rows] == [p.upper() for p in prompts] and len(log.load(4)) == 60
    assert sorted(made[before:]) == sorted(set(prompts) - set(finished))


def test_a_log_is_read_by_the_next_run(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    d = spark.range(20).select(F.concat(F.lit("p"), "id").alias("prompt"), F.lit("x").alias("other"))
    assert sorted(r.text for r in calls.function_calls(d, str.upper, workers=2, log=log).collect()) == sorted(f"P{k}" for k in range(20))
    again = calls.function_calls(d, lambda p: 1 / 0, workers=2, log=log).collect()
    assert all(r.error is None for r in again) and len(again) == 20
    other = calls.function_calls(d.withColumn("other", F.lit("y")), lambda p: 1 / 0, workers=2, log=log).collect()
    assert all(r.error for r in other)


def test_null_prompts_and_repeated_rows(spark):
    d = spark.createDataFrame([("a",), ("a",), (None,)], "prompt string")
    got = calls.function_calls(d, lambda p: str(p), workers=2).collect()
    assert sorted((r.text, r.input_tokens) for r in got) == [("None", 0), ("a", 1), ("a", 1)]
    with pytest.raises(ValueError, match="under way"):
        calls.function_calls(d, str, flight=0)
