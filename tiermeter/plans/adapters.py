"""Decision tables derived from the driver's tables, in Spark and as DuckDB SQL.

Each adapter has a Spark form that gives the engine's own schema and a SQL text
(a ``WITH`` clause) that the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermeter.functions.sampling import uniform_draw
from tiermeter.schema import ATTEMPT, COMPLETION, CONFIDENCE, JUDGEMENT, SHADOW, TASK, struct_of

THRESHOLD = 0.55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(events: DataFrame) -> DataFrame:
    """The flat facts behind the decisions of ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    e, u = F.col("event_id"), F.col("user_id")
    flat = events.select(
        "event_id", F.col("event_id").cast("string").alias("task_id"), "user_id", "event_type", "value", "ts",
        F.when(F.col("event_type") != "signup", k / F.lit(100.0)).alias("score"),
        (F.col("event_type") == "error").alias("failed"),
        ((e * 7919 + u * 31 + 17) % 1000).alias("h1"), ((e * 104729 + u * 7 + 3) % 1000).alias("h2"), ((e * 1299709 + 11) % 1000).alias("h3"),
    )
    flat = flat.withColumn("fast_ok", F.col("h1") < 500 + 450 * F.coalesce("score", F.lit(0.0))).withColumn("slow_ok", F.col("h2") < 900)
    s = F.col("score")
    return flat.select(
        "*",
        ((F.col("fast_ok") & F.col("slow_ok")) | (~F.col("fast_ok") & ~F.col("slow_ok") & (F.col("h3") < 440))).alias("agree"),
        F.when((s >= 0.55) & (s < 0.9), 0.5).when((s >= 0.9) & (s <= 1.0), 0.2).otherwise(0.1).alias("pi"),
        (~F.col("failed") & F.coalesce(s >= THRESHOLD, F.lit(False))).alias("accepted"),
        uniform_draw(F.lit("0"), F.lit("r"), F.col("task_id")).alias("u"),
        F.when(e % 97 != 0, F.lit(0.0001) * (1 + F.col("value") / 100)).alias("fast_cost"),
        (F.lit(0.002) * (1 + F.col("value") / 100)).alias("slow_cost"),
    )


FACTS_SQL = """
f0 AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS task_id, user_id, event_type, value, ts,
    CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0e0 END AS score,
    event_type = 'error' AS failed,
    (event_id * 7919 + user_id * 31 + 17) % 1000 AS h1, (event_id * 104729 + user_id * 7 + 3) % 1000 AS h2, (event_id * 1299709 + 11) % 1000 AS h3
  FROM events
), f1 AS (
  SELECT *, h1 < 500 + 450 * coalesce(score, 0.0e0) AS fast_ok, h2 < 900 AS slow_ok FROM f0
), facts AS (
  SELECT *, (fast_ok AND slow_ok) OR (NOT fast_ok AND NOT slow_ok AND h3 < 440) AS agree,
    CASE WHEN score >= 0.55e0 AND score < 0.9e0 THEN 0.5e0 WHEN score >= 0.9e0 AND score <= 1.0e0 THEN 0.2e0 ELSE 0.1e0 END AS pi,
    NOT failed AND coalesce(score >= 0.55e0, FALSE) AS accepted,
    CAST(('0x' || sha256('0|r|' || task_id)[1:16]) AS UBIGINT)::DOUBLE / 18446744073709551616.0e0 AS u,
    CASE WHEN event_id % 97 <> 0 THEN 0.0001e0 * (1 + value / 100) END AS fast_cost,
    0.002e0 * (1 + value / 100) AS slow_cost
  FROM f1
)"""


def _attempt(tier: str, ok: Column, accepted: Column, cost: Column, *, score: Column | None = None, threshold: float | None = None, error: Column | None = None, agreement: Column | None = None, graded: Column) -> Column:
    failed = error.isNotNull() if error is not None else F.lit(False)
    completion = F.when(~failed, struct_of(COMPLETION, text=F.when(ok, F.lit("right")).otherwise(F.lit("wrong")), model=F.lit(tier), cost_usd=cost, latency_s=F.lit(0.5 if tier == "fast" else 2.0)))
    return struct_of(
        ATTEMPT, tier=F.lit(tier), backend=F.lit(tier), answer=F.when(~failed, F.when(ok, F.lit("right")).otherwise(F.lit("wrong"))), threshold=F.lit(threshold), accepted=accepted, error=error if error is not None else F.lit(None),
        completion=completion, confidence=struct_of(CONFIDENCE, estimator=F.lit("verbal"), score=score, calls=F.array()) if score is not None else F.lit(None),
        correct=F.when(graded & ~failed, struct_of(JUDGEMENT, equivalent=ok, comparator=F.lit("exact"), calls=F.array())),
        agreement=F.when(agreement.isNotNull(), struct_of(JUDGEMENT, equivalent=agreement, comparator=F.lit("exact"), calls=F.array())) if agreement is not None else F.lit(None),
    )


def decisions(events: DataFrame, mode: str = "serve", run_id: str = "r") -> DataFrame:
    """Decisions of a two-tier cascade in the engine's schema.

    ``serve``: the slow tier runs where the fast one isn't accepted; accepted
    cases are audited where the draw is below their inclusion probability, with
    some audits pending (ids divisible by 53), in error (59) or undecided (61),
    some cases without a record (67) and some with an invalid probability (71).
    ``eval``: both tiers run, and every case has the agreement.
    """
    d = facts(events)
    e, failed, accepted = F.col("event_id"), F.col("failed"), F.col("accepted")
    graded = e % 10 != 9
    slow_error = F.when(failed, F.lit("final tier failed"))
    undecided = e % 61 == 0
    fast = _attempt("fast", F.col("fast_ok"), accepted, F.col("fast_cost"), score=F.col("score"), threshold=THRESHOLD, graded=graded, agreement=F.when(~failed & ~undecided, F.col("agree")) if mode == "eval" else None)
    slow = _attempt("slow", F.col("slow_ok"), ~accepted & ~failed, F.col("slow_cost"), error=slow_error, graded=graded)
    audited = F.col("u") < F.col("pi")
    status = F.when(audited, F.when(e % 53 == 0, "pending").when(e % 59 == 0, "error").otherwise("done")).otherwise("skipped")
    shadow = struct_of(
        SHADOW, audit_tier=F.lit("slow"), inclusion_prob=F.when(e % 71 == 0, 0.0).otherwise(F.col("pi")), status=status,
        attempt=F.when(status == "done", _attempt("slow", F.col("slow_ok"), F.lit(True), F.col("slow_cost"), graded=graded)),
        agreement=F.when(status == "done", struct_of(JUDGEMENT, equivalent=F.when(~undecided, F.col("agree")), comparator=F.lit("exact"), calls=F.array())),
    )
    both = mode == "eval"
    served_ok = F.when(accepted | failed, F.col("fast_ok")).otherwise(F.col("slow_ok"))
    slow_spent = F.when(failed, 0.0).otherwise(F.col("slow_cost"))
    return d.select(
        F.lit(run_id).alias("run_id"), e.alias("seq"), F.lit(mode).alias("mode"),
        struct_of(TASK, id=F.col("task_id"), prompt=F.concat(F.lit("task "), F.col("task_id")), reference=F.when(graded, F.lit("right")), meta=F.to_json(F.struct("event_type"))).alias("task"),
        F.when(served_ok, F.lit("right")).otherwise(F.lit("wrong")).alias("answer"),
        F.when(accepted | failed, "fast").otherwise("slow").alias("final_tier"), (~accepted).alias("escalated"),
        (F.array(fast, slow) if both else F.when(accepted, F.array(fast)).otherwise(F.array(fast, slow))).alias("attempts"),
        (F.lit(None).cast(SHADOW) if both else F.when(accepted & (e % 67 != 0), shadow)).alias("shadow"),
        F.when(accepted, F.col("fast_cost")).otherwise(F.col("fast_cost") + slow_spent).alias("cost_usd"),
        (F.when(accepted, F.col("slow_cost")).otherwise(0.0) if both else F.when(accepted & (e % 67 != 0) & (status == "done"), F.col("slow_cost")).otherwise(0.0)).alias("audit_cost_usd"),
        F.lit(0.5).alias("latency_s"), F.when(graded, struct_of(JUDGEMENT, equivalent=served_ok, comparator=F.lit("exact"), calls=F.array())).alias("correct"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), slow_error.alias("error"),
    )


#: The cases of ``decisions(mode="serve")`` as SQL, for oracles.
CASES_SQL = (
    FACTS_SQL
    + """, cases AS (
  SELECT task_id, event_id, score, fast_ok, slow_ok, slow_cost,
    CASE WHEN event_id % 67 = 0 OR event_id % 71 = 0 THEN NULL ELSE pi END AS pi,
    CASE WHEN event_id % 67 = 0 THEN 'none' WHEN event_id % 71 = 0 THEN 'invalid'
      WHEN u >= pi THEN 'not-selected' WHEN event_id % 53 = 0 THEN 'pending' WHEN event_id % 59 = 0 THEN 'error'
      WHEN event_id % 61 = 0 THEN 'undecided' ELSE 'audited' END AS state,
    NOT agree AS disagree, CASE WHEN event_id % 10 <> 9 THEN NOT fast_ok END AS wrong
  FROM facts WHERE accepted
), strata AS (
  SELECT pi, count(*) AS members, count(*) FILTER (WHERE state IN ('audited','undecided','pending','error','none')) AS selected,
    count(*) FILTER (WHERE state = 'audited') AS completed
  FROM cases WHERE pi IS NOT NULL GROUP BY pi
), weighted AS (
  SELECT c.*, 1.0e0 / (c.pi * (s.completed::DOUBLE / s.selected)) AS w
  FROM cases c JOIN strata s ON c.pi = s.pi WHERE c.state = 'audited'
)"""
)


def tiers3(lineitem: DataFrame) -> DataFrame:
    """Items of a three-tier evaluation: scores, grades and costs by tier, one row for each line."""
    key = F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd")), 256)
    n = lambda first: F.conv(F.substring(key, first, 7), 16, 10).cast("bigint") % 1000
    return lineitem.select(
        key.alias("task_id"), F.round(F.col("l_discount") * 1000).cast("bigint").alias("s1"), F.round(F.col("l_tax") * 1250).cast("bigint").alias("s2"),
        (n(1) < 600 + 3 * F.round(F.col("l_discount") * 1000)).alias("ok1"), (n(9) < 750 + F.round(F.col("l_tax") * 1250)).alias("ok2"), (n(17) < 950).alias("ok3"),
        F.col("l_quantity").cast("bigint").alias("tokens"),
    )


TIERS3_SQL = """
k AS (
  SELECT *, sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS INTEGER) || '|' || strftime(l_shipdate, '%Y%m%d')) AS key
  FROM lineitem
), items AS (
  SELECT key AS task_id, CAST(round(l_discount * 1000) AS BIGINT) AS s1, CAST(round(l_tax * 1250) AS BIGINT) AS s2,
    CAST('0x' || key[1:7] AS BIGINT) % 1000 < 600 + 3 * round(l_discount * 1000) AS ok1,
    CAST('0x' || key[9:15] AS BIGINT) % 1000 < 750 + round(l_tax * 1250) AS ok2,
    CAST('0x' || key[17:23] AS BIGINT) % 1000 < 950 AS ok3,
    CAST(l_quantity AS BIGINT) AS tokens
  FROM k
)"""


def scored(events: DataFrame) -> DataFrame:
    """(``score``, ``label``) pairs for calibration: finite scores with a graded answer."""
    return facts(events).where("score is not null and not failed and event_id % 10 <> 9").select("event_id", "score", "fast_ok")


SCORED_SQL = FACTS_SQL + ", scored AS (SELECT event_id, score, fast_ok FROM facts WHERE score IS NOT NULL AND NOT failed AND event_id % 10 <> 9)"


def replies(conversations: DataFrame) -> DataFrame:
    """Assistant turns as model replies with ANSWER and CONFIDENCE lines."""
    a, c = (F.col("conv_id") * 37 + F.col("turn") * 11) % 1000, (F.col("conv_id") * 13 + F.col("turn") * 29) % 101
    text = F.concat("text", F.lit("\nANSWER: "), a.cast("string"), F.lit("\nCONFIDENCE: "), c.cast("string"), F.lit("%"))
    return conversations.where("role = 'assistant'").select("conv_id", "turn", a.cast("string").alias("reference"), text.alias("reply"))


REPLIES_SQL = """
replies AS (
  SELECT conv_id, turn, CAST((conv_id * 37 + turn * 11) % 1000 AS VARCHAR) AS reference,
    text || chr(10) || 'ANSWER: ' || ((conv_id * 37 + turn * 11) % 1000) || chr(10) || 'CONFIDENCE: ' || ((conv_id * 13 + turn * 29) % 101) || '%' AS reply
  FROM conversations WHERE role = 'assistant'
)"""
