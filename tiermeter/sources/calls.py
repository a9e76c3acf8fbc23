"""Sources of completions: keys, cache, replay and callables."""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a request that make its key; tags don't.
KEY_FIELDS = ("prompt", "system", "model", "max_tokens", "temperature", "n_sample")


def request_key(backend: Column, **fields: Column) -> Column:
    """SHA-256 of the request as compact JSON with sorted keys."""
    unknown = set(fields) - set(KEY_FIELDS)
    if unknown:
        raise ValueError(f"not part of a key: {', '.join(sorted(unknown))}")
    parts = {"backend": backend, **fields}
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())])), 256)


def with_cache(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All requests answered, and the new cache rows.

    ``requests`` and ``cache`` have a ``key``; ``call`` answers the distinct missing
    keys once (``key``, ``text``, ``error``). Errors are returned but not cached.
    """
    missing = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = call(missing)
    hits = cache.select("key", F.col("text").alias("text"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    answers = hits.unionByName(new.select("key", "text", "error", F.lit(False).alias("cached")))
    return requests.join(answers, "key", "left"), new.where("error is null").select("key", "text")


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded completions by key, else by task and tier, else by task.

    ``recorded`` has ``key``, ``task_id``, ``tier`` (nullable) and ``text``; of several
    rows for the same lookup the one of lowest text counts.
    """
    def by(cond: Column, *keys: str) -> DataFrame:
        return recorded.where(cond).groupBy(*keys).agg(F.min("text").alias("text"))

    k, t, i = F.col("key").isNotNull(), F.col("tier").isNotNull(), F.col("task_id").isNotNull()
    one = by(k, "key").withColumnRenamed("text", "__a")
    two = by(~k & i & t, "task_id", "tier").withColumnRenamed("text", "__b")
    three = by(~k & i & ~t, "task_id").withColumnRenamed("text", "__c")
    out = requests.join(one, "key", "left").join(two, ["task_id", "tier"], "left").join(three, "task_id", "left")
    return out.withColumn("text", F.coalesce("__a", "__b", "__c")).drop("__a", "__b", "__c")


class RetryPolicy:
    """Exponential backoff with full jitter."""

    def __init__(self, attempts: int = 6, first_s: float = 1.0, most_s: float = 60.0):
        self.attempts, self.first_s, self.most_s = attempts, first_s, most_s

    def run(self, f: Callable[[], str], sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
        rng = rng or random.Random()
        for k in range(self.attempts):
            try:
                return f()
            except Exception as e:  # noqa: BLE001  any failure of a call may be retried
                if k + 1 == self.attempts or getattr(e, "permanent", False):
                    raise
                wait = getattr(e, "retry_after", None)
                sleep(wait if wait is not None else rng.uniform(0, min(self.most_s, self.first_s * 2**k)))
        raise RuntimeError("no attempts")


COMPLETIONS = "text string, error string, input_tokens long, output_tokens long, latency_s double"
#: Calls that one task has under way at once.
IN_FLIGHT = 8
#: Results that may wait for a slower one before them, for each call under way.
HELD = 4


def _one_call(prompt: str | None, f: Callable[[str], str], policy: RetryPolicy) -> tuple:
    """A row of ``COMPLETIONS``; a failure is kept as ``error``."""
    began, text, error = time.monotonic(), None, None
    try:
        text = str(policy.run(lambda: f(prompt)))
    except Exception as e:  # noqa: BLE001  recorded, not raised
        error = f"{type(e).__name__}: {e}"
    return text, error, math.ceil(len(prompt or "") / 4), math.ceil(len(text or "") / 4), time.monotonic() - began


def in_flight(keys: Iterable[str], prompts: Iterable[str | None], f: Callable[[str], str], policy: RetryPolicy, most: int, done: dict[str, tuple], keep: Callable[[str, tuple], None]) -> Iterator[tuple]:
    """Results in order, with at most ``most`` calls under way; each is given to ``keep`` as soon as it comes.

    Keys in ``done`` aren't called. A result waits for those before it, so that a
    slow call doesn't stop the others; ``HELD`` times ``most`` calls and results are held.
    """
    waiting: deque[tuple | Future] = deque()

    def call(key: str, prompt: str | None) -> tuple:
        row = _one_call(prompt, f, policy)
        if row[1] is None:  # what failed is tried again by a task that is run again
            keep(key, row)
        return row

    pool = ThreadPoolExecutor(most)
    try:
        for key, prompt in zip(keys, prompts, strict=True):
            waiting.append(done[key] if key in done else pool.submit(call, key, prompt))
            while len(waiting) >= HELD * most:
                first = waiting.popleft()
                yield first.result() if isinstance(first, Future) else first
        for first in waiting:
            yield first.result() if isinstance(first, Future) else first
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


class CallLog:
    """Results of calls as they come, a small file each, below a folder that the cluster shares.

    A task that runs again finds there what it has finished, so it repeats only
    what was under way. ``folder`` is read and written by pyarrow's file systems, from
    any executor.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def _part(self, part: int) -> tuple[fs.FileSystem, str]:
        system, at = self._system()
        return system, f"{at}/part={part:05d}"

    def load(self, part: int) -> dict[str, tuple]:
        system, at = self._part(part)
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        out = {}
        for info in system.get_file_info(fs.FileSelector(at)):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as source:
                    key, row = json.loads(source.read())
                out[key] = tuple(row)
        return out

    def keeper(self, part: int) -> Callable[[str, tuple], None]:
        system, at = self._part(part)
        system.create_dir(at, recursive=True)

        def keep(key: str, row: tuple) -> None:
            half = f"{at}/{key}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(half) as target:
                target.write(json.dumps([key, row]).encode())
            system.move(half, f"{at}/{key}.json")

        return keep


def function_calls(requests: DataFrame, f: Callable[[str], str], workers: int = 8, retries: RetryPolicy | None = None, flight: int = IN_FLIGHT, log: str | None = None) -> DataFrame:
    """Call a Python function on each request's ``prompt``; failures are kept as ``error``.

    ``workers`` tasks have ``flight`` calls under way each, in threads, so ``f`` is called
    side by side. With ``log``, a folder in a file system that executors share, each
    result is kept there when it comes, by the hash of its row; a task that runs again calls only
    what it hadn't finished (a call that was under way may happen twice). Without, a
    repeated task calls all of its rows again: write the result before it is used twice.
    """
    policy = retries or RetryPolicy(attempts=1)
    names = requests.columns
    if flight < 1:
        raise ValueError("one call at least is under way")

    def run(batches):
        part = TaskContext.get().partitionId()
        calls = CallLog(log) if log else None
        done, keep = (calls.load(part), calls.keeper(part)) if calls else ({}, lambda key, row: None)
        for pdf in batches:
            keys = pdf.pop("__key")
            rows = list(in_flight(keys, [None if p is None else str(p) for p in pdf["prompt"]], f, policy, flight, done, keep))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in COMPLETIONS.split(", ")])], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    # Dealt by content, so that a task that runs again has the same rows.
    key = F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}), 256).alias("__key")
    return requests.select(*[F.col(f"`{n}`") for n in names], key).repartition(workers, "__key").mapInPandas(run, f"{schema}, {COMPLETIONS}")
