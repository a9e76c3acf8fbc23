"""Comparators and confidence estimators that ask another answerer.

Calls go through ``sources.calls.function_calls`` and are written before they are
read, since they cost money. Cases that need no call are settled first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.functions.exprs import verbal_confidence, verdict
from tiermeter.functions.text import compare, extract, fill
from tiermeter.operators.simulate import self_consistency
from tiermeter.sources.calls import RetryPolicy, function_calls
from tiermeter.sources.tables import kept

JUDGE_PROMPT = """Say whether two answers to a question come to the same result.
Question: {question}
First answer: {target}
Second answer: {candidate}
End with a line VERDICT: EQUIVALENT or VERDICT: DIFFERENT."""
MONITOR_PROMPT = """How likely is this answer right?
Question: {question}
Answer: {candidate}
End with a line P(correct): and a number from 0 to 1."""

Ask = Callable[[str], str]


def filled(template: str, **columns: Column) -> Column:
    """The template with its placeholders filled in one pass: values aren't looked at again."""
    names = list(columns)

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([fill(template, dict(zip(names, (v or "" for v in row), strict=True))) for row in zip(*series, strict=True)])

    run.__annotations__ = {}
    return F.pandas_udf(run, "string", functionType=200)(*columns.values())


def judged(pairs: DataFrame, ask: Ask, prompt: str = JUDGE_PROMPT, workers: int = 8, retries: RetryPolicy | None = None) -> DataFrame:
    """``pairs`` (``id``, ``question``, ``candidate``, ``target``) with ``equivalent`` and ``by``.

    Answers that are equal after normalising need no call; blank ones are settled
    too. A failed call or a reply without a verdict leaves ``equivalent`` null.
    """
    plain = kept(pairs.withColumn("equivalent", compare(F.col("candidate"), F.col("target"), "normalized")), "compared")
    blank = F.trim(F.coalesce("candidate", F.lit(""))) == ""
    settled = plain.where(F.coalesce("equivalent", F.lit(False)) | blank).withColumn("by", F.lit("normalized"))
    open_ = plain.where(~(F.coalesce("equivalent", F.lit(False)) | blank)).drop("equivalent")
    asked = function_calls(open_.withColumn("prompt", filled(prompt, question=F.col("question"), candidate=F.col("candidate"), target=F.col("target"))), ask, workers, retries)
    answered = kept(asked, "verdicts").select(*pairs.columns, F.when(F.col("error").isNull(), verdict(F.col("text"))).alias("equivalent"), F.lit("judge").alias("by"))
    return settled.unionByName(answered)


def monitored(answers: DataFrame, ask: Ask, prompt: str = MONITOR_PROMPT, workers: int = 8) -> DataFrame:
    """``answers`` (``id``, ``question``, ``candidate``) with the ``score`` that another answerer gives; blank answers aren't asked about."""
    blank = F.trim(F.coalesce("candidate", F.lit(""))) == ""
    asked = function_calls(answers.where(~blank).withColumn("prompt", filled(prompt, question=F.col("question"), candidate=F.col("candidate"))), ask, workers)
    scored = kept(asked, "monitor").select(*answers.columns, F.when(F.col("error").isNull(), verbal_confidence(F.col("text"), monitor=True)).alias("score"))
    return scored.unionByName(answers.where(blank).withColumn("score", F.lit(None).cast("double")))


def sampled(answers: DataFrame, ask: Callable[[str], str], samples: int = 4, extractor: str = "final_line", workers: int = 8) -> DataFrame:
    """``answers`` (``id``, ``prompt``, ``candidate``) with the ``score`` of how many more samples agree."""
    more = answers.select("id", "prompt", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    got = kept(function_calls(more, ask, workers), "samples")
    votes = got.groupBy("id").agg(F.collect_list(F.struct(F.when(F.col("error").isNull(), extract(F.col("text"), extractor)).alias("v"))).alias("votes"))  # ``samples`` rows each
    joined = answers.join(votes, "id", "left")
    return joined.withColumn("score", self_consistency(F.transform("votes", lambda x: x["v"]), F.col("candidate"))).drop("votes")
