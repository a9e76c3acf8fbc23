import signal
import sys

import pytest
from pyspark.sql import functions as F

import tiermeter
from tiermeter import config
from tiermeter.functions import estimators, stats
from tiermeter.operators import montecarlo
from tiermeter.operators.cascade import AuditPolicy, Tier
from tiermeter.operators.simulate import Answerer
from tiermeter.sources import backends, ledger
from tiermeter.streaming import runner as running

ECHO = [sys.executable, "-c", "import sys; print('thinking\\nANSWER: ' + sys.stdin.read()[::-1] + '\\nCONFIDENCE: 80%')"]


def shout(prompt: str) -> str:
    return f"ANSWER: {prompt.upper()}\nCONFIDENCE: 0.5"


def tasks(spark, n=6):
    return spark.createDataFrame([(k, f"t{k}", f"ab{k}", str(k), None, 1.0) for k in range(n)], running.TASKS)


def test_every_public_name_is_there():
    assert all(getattr(tiermeter, n) is not None for n in tiermeter.__all__)
    with pytest.raises(AttributeError):
        tiermeter.nothing


def test_commands():
    assert backends.Command(ECHO)("abc").splitlines()[1] == "ANSWER: cba"
    assert backends.Command([sys.executable, "-c", "import sys; print(sys.argv[1])", "<{prompt}>"])("$(x)") == "<$(x)>"
    assert backends.Command([sys.executable, "-c", "print('{\"a\": {\"b\": 3}}')"], json_path="a.b")("x") == "3"
    for argv, options, match in (([sys.executable, "-c", "raise SystemExit(3)"], {}, "exit code 3"), (["no-such-program"], {}, "no program"), ([sys.executable, "-c", "import time; time.sleep(9)"], {"timeout_s": 0.3}, "no reply"), ([sys.executable, "-c", "print(1)"], {"json_path": "a"}, "in the output")):
        with pytest.raises(backends.CommandError, match=match):
            backends.Command(argv, **options)("x")
    for bad in ({"argv": []}, {"argv": [1]}, {"argv": ["x"], "timeout_s": 0}):
        with pytest.raises(ValueError):
            backends.Command(**bad)


def test_backends_by_name(spark):
    by_command = backends.backend("command", "fast", {"argv": ECHO, "workers": 2, "output_price": 1.0})
    rows = {r.id: r for r in by_command(tasks(spark, 2)).collect()}
    assert rows["t1"].answer == "1ba" and rows["t1"].score == pytest.approx(0.8) and rows["t1"].error is None and rows["t1"].cost_usd > 0
    failing = {r.id: r for r in backends.backend("command", "x", {"argv": ["no-such-program"]})(tasks(spark, 1)).collect()}["t0"]
    assert "no program" in failing.error and failing.cost_usd is None and failing.score is None
    by_function = backends.backend("function", "f", {"function": f"{__name__}:shout"}, estimator={"type": "combine", "parts": ["verbal", "verbal"], "method": "min"})
    assert by_function.call("a").startswith("ANSWER: A")
    for kind, options in (("no", {}), ("command", {"argv": ECHO, "bogus": 1}), ("function", {"function": "no.such:thing"}), ("function", {"function": "json"})):
        with pytest.raises((ValueError, TypeError)):
            backends.backend(kind, "x", options)


def test_fingerprints_tell_settings_apart():
    one = backends.fingerprint("command", {"argv": ["a"], "api_key": "1", "workers": 3})
    assert one == backends.fingerprint("command", {"argv": ["a"], "api_key": "2", "workers": 9}) and len(one) == 16
    assert len({one, backends.fingerprint("command", {"argv": ["b"], "api_key": "1"}), backends.fingerprint("function", {"argv": ["a"], "api_key": "1"})}) == 3


def test_configured_parts():
    c = config.parse({"tiers": [{"name": "a", "backend": "command", "threshold": 0.5, "options": {"argv": ["x"]}, "estimator": "verbal", "extractor": {"type": "choice", "letters": "AB"}}, {"name": "b", "backend": "simulated"}]})
    assert c.tiers[0].backend.extractor("ANSWER: B") == "B"
    for part, value, match in (("estimator", "no", "unknown estimator"), ("extractor", {"type": "regex"}, "pattern"), ("comparator", {"type": "numeric", "percent": "x"}, "percent"), ("options", {"argv": []}, "argv")):
        with pytest.raises(config.ConfigError, match=match):
            config.parse({"tiers": [{"name": "a", "backend": "command", **({} if part == "options" else {"options": {"argv": ["x"]}}), part: value}]})


@pytest.mark.parametrize(("spec", "want"), [
    (None, 0.7), ("verbal", 0.7), ({"type": "logprob", "aggregate": "min"}, 0.5), ({"type": "combine", "parts": ["verbal", {"type": "logprob", "aggregate": "min"}], "method": "weighted", "weights": [3, 1]}, 0.65),
    ({"type": "calibrated", "base": "verbal", "points": [[0.0, 0.0], [1.0, 0.5]]}, 0.35), ("self_consistency", 2 / 3), ("monitor", 0.3), ({"type": "function", "call": lambda t, a: 7, "columns": ["text", "answer"]}, 1.0), ({"type": "function", "call": lambda t: float("nan"), "columns": ["text"]}, None), ({"type": "function", "call": lambda t: 1 / 0, "columns": ["text"]}, None),
])
def test_estimators(spark, spec, want):
    import math

    columns = {"text": F.lit("ANSWER: 4\nCONFIDENCE: 70%"), "answer": F.lit("4"), "logprobs": F.array(F.lit(math.log(0.5)), F.lit(0.0)), "votes": F.array(F.lit("4"), F.lit("5")), "monitor_text": F.lit("P(correct): 0.3")}
    d = spark.range(1).select(*[c.alias(k) for k, c in columns.items()])
    got = d.select(estimators.estimator(spec)({k: F.col(k) for k in columns}).alias("s")).first().s
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("spec", ["no", {"type": "verbal", "x": 1}, {"type": "combine", "parts": []}, {"type": "logprob", "aggregate": "median"}, {"type": "calibrated", "base": "verbal", "points": []}, {"type": "combine", "parts": ["verbal"], "method": "weighted"}, ["verbal"]])
def test_bad_estimators(spec):
    with pytest.raises(ValueError):
        estimators.estimator(spec)


def test_ledger_versions_and_drift(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    book = ledger.Ledger(spark, path)
    assert book.migrate() == ledger.VERSION
    book.start_run("r", {"a": {"b": 1, "api_key": "x"}, "c": [1, 2]})
    assert book.drift("r", {"a": {"b": 1, "api_key": "other"}, "c": [1, 2]}) == [] and book.drift("none", {}) == []
    assert book.drift("r", {"a": {"b": 2, "api_key": "x"}, "c": [1, 3]}) == ["a.b", "c[1]"]
    spark.createDataFrame([(ledger.VERSION + 1,)], "version int").write.mode("append").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="version"):
        ledger.Ledger(spark, path)


def test_runner_counts_along_and_stops(spark, tmp_path):
    tiers = (Tier("fast", Answerer("fast", skill=3.0), 0.6), Tier("slow", Answerer("slow", skill=6.0)))
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    run = running.Runner(book, tiers, "r", audit=AuditPolicy(rate=0.5))
    t = tasks(spark, 12)
    run.process(t.where("seq < 6").union(t.where("seq < 3")))  # repeated tasks
    run.process(t.where("seq < 9"))
    got, whole = run.spent, run.counters()
    assert got["total"] == whole["total"] == 9 and got["cost"] == pytest.approx(whole["cost"]) and got["escalated"] == whole["escalated"]
    with run.interruptible():
        signal.raise_signal(signal.SIGINT)
        with pytest.raises(running.Stopped, match="interrupted"):
            run.process(t)
        with pytest.raises(KeyboardInterrupt):
            signal.raise_signal(signal.SIGINT)
    again = running.Runner(book, tiers, "r", limits=running.Limits(budget_usd=whole["cost"] / 2))
    with pytest.raises(running.Stopped, match="budget"):
        again.process(t)
    running.Runner(book, tiers, "r").process(t)
    assert book.decisions("r").count() == 12


@pytest.mark.parametrize("stretch", [3, 1 << 20])
def test_streaks_across_stretches(spark, monkeypatch, stretch):
    import itertools
    import random

    monkeypatch.setattr(running, "STRETCH", stretch)
    rng = random.Random(stretch)
    runs = {f"r{k}": [rng.random() < 0.7 for _ in range(rng.randint(1, 30))] for k in range(20)} | {"good": [False] * 5, "bad": [True] * 17}
    rows = [(r, k, "e" if bad else None) for r, seq in runs.items() for k, bad in enumerate(seq)]
    got = {r.run_id: r.streak for r in running.failure_streak(spark.createDataFrame(rows, "run_id string, seq long, error string")).collect()}
    want = {r: max((len(list(g)) for bad, g in itertools.groupby(seq) if bad), default=0) for r, seq in runs.items()}
    assert got == {r: n for r, n in want.items() if n}


def test_bootstrap_of_a_column(spark):
    rows = [(float(k % 10),) for k in range(2000)] + [(None,), (float("nan"),)]
    d = spark.createDataFrame(rows, "x double").repartition(3)
    e = montecarlo.bootstrap_mean(d, "x", reps=500)
    half = 1.96 * 2.872 / 2000**0.5
    assert e.value == pytest.approx(4.5) and e.n == 2000 and abs(e.lo - (4.5 - half)) < 0.03 and abs(e.hi - (4.5 + half)) < 0.03
    assert montecarlo.bootstrap_mean(d.limit(0), "x") is None
    assert stats.paired_difference(0, 0, 1).value == 1.0 and stats.paired_difference(0, 0, 1).lo is None
