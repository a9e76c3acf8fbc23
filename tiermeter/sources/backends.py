"""Backends by name: what answers a tier's tasks."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.functions import estimators, text
from tiermeter.operators.simulate import Answerer
from tiermeter.sources.calls import IN_FLIGHT, RetryPolicy, function_calls
from tiermeter.sources.ledger import redacted


class CommandError(RuntimeError):
    """A command that failed; it is not tried again where ``permanent``."""

    permanent = False


class Command:
    """Runs a program for each prompt, which takes the place of ``{prompt}`` in its arguments or is its input.

    The reply is what it prints, or a dotted path of that as JSON. No shell reads
    the arguments. An exit code but 0, a timeout or unreadable output is an error.
    """

    def __init__(self, argv: list | tuple, timeout_s: float = 600.0, json_path: str | None = None, env: dict[str, str] | None = None):
        if not argv or not all(isinstance(a, str) for a in argv):
            raise ValueError("argv: a list of strings")
        if timeout_s <= 0:
            raise ValueError("timeout_s: above 0")
        self.argv, self.timeout_s, self.json_path, self.env = tuple(argv), timeout_s, json_path, env

    def __call__(self, prompt: str) -> str:
        placed = any("{prompt}" in a for a in self.argv)
        argv = [text.fill(a, {"prompt": prompt}) for a in self.argv]
        try:
            done = subprocess.run(argv, input=None if placed else prompt, capture_output=True, text=True, timeout=self.timeout_s, env={**os.environ, **(self.env or {})}, check=False)
        except FileNotFoundError as e:
            error = CommandError(f"no program {self.argv[0]!r}")
            error.permanent = True
            raise error from e
        except subprocess.TimeoutExpired as e:
            raise CommandError(f"no reply after {self.timeout_s} s") from e
        if done.returncode:
            raise CommandError(f"exit code {done.returncode}: {done.stderr.strip()[-500:]}")
        if self.json_path is None:
            return done.stdout.rstrip("\n")
        found = text.json_field(self.json_path)(done.stdout)
        if not found:
            raise CommandError(f"no {self.json_path!r} in the output")
        return found


def named_function(path: str) -> Callable[[str], str]:
    """``package.module:name``."""
    module, _, name = path.partition(":")
    if not name:
        raise ValueError("function: written as module:name")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"function: {e}") from e
    if not callable(found):
        raise ValueError(f"function: {path} can't be called")
    return found


class Calls:
    """A backend that calls a function or program for each prompt, and reads answer and score from its reply."""

    def __init__(self, call: Callable[[str], str], estimator: str | dict | None = None, extractor: str | dict | None = None, workers: int = 8, attempts: int = 1, input_price: float = 0.0, output_price: float = 0.0, flight: int = IN_FLIGHT, log: str | None = None):
        self.call, self.workers, self.retries = call, workers, RetryPolicy(attempts)
        self.flight, self.log = flight, log
        self.score, self.extractor = estimators.estimator(estimator), text.extractor(extractor)
        self.prices = (input_price, output_price)

    def __call__(self, tasks: DataFrame) -> DataFrame:
        got = function_calls(tasks, self.call, self.workers, self.retries, self.flight, self.log)
        pick = self.extractor
        answer = F.pandas_udf(lambda s: s.map(pick), "string")(F.col("text"))
        got = got.withColumn("answer", answer)
        cost = (F.col("input_tokens") * self.prices[0] + F.col("output_tokens") * self.prices[1]) / 1e6
        return got.withColumn("score", self.score({"text": F.col("text"), "answer": F.col("answer")})).withColumn("cost_usd", F.when(F.col("error").isNull(), cost)).drop("input_tokens", "output_tokens")


_CALLS = tuple(k for k in inspect.signature(Calls).parameters if k not in ("call", "estimator", "extractor"))


def _calls(call: Callable[..., Callable[[str], str]], options: dict, parts: dict) -> Calls:
    own = {k: v for k, v in options.items() if k not in _CALLS}
    return Calls(call(**own), parts.get("estimator"), parts.get("extractor"), **{k: v for k, v in options.items() if k in _CALLS})


#: By name: from the tier's name, its options and its parts (``estimator``, ``extractor``).
BACKENDS: dict[str, Callable[[str, dict, dict], Callable | Answerer]] = {
    "simulated": lambda name, options, parts: Answerer(name, **options),
    "command": lambda name, options, parts: _calls(Command, options, parts),
    "function": lambda name, options, parts: _calls(lambda function: named_function(function), options, parts),
}


def backend(kind: str, name: str, options: dict | None = None, **parts) -> Callable | Answerer:
    """A backend by name; unknown names and options are errors."""
    if kind not in BACKENDS:
        raise ValueError(f"unknown backend {kind!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[kind](name, dict(options or {}), parts)


def fingerprint(kind: str, options: dict | None = None) -> str:
    """16 hexadecimal digits of a backend's settings, without secrets and what changes no answer.

    As the ``backend`` of a request's key, it keeps a cache from serving another
    configuration's answers.
    """
    same = {k: v for k, v in redacted(options or {}).items() if k not in ("workers", "attempts", "flight", "log", "timeout_s", "input_price", "output_price", "latency_s")}
    return hashlib.sha256(json.dumps([kind, same], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
