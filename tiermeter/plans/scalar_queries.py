"""Queries over texts, confidences, prices, logs and calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermeter.functions import exprs, pricing, text
from tiermeter.functions.sampling import inclusion_prob as band_prob
from tiermeter.functions.sampling import uniform_draw
from tiermeter.operators import audit
from tiermeter.operators.cascade import AuditPolicy, Tier, route
from tiermeter.operators.matching import longest_contained
from tiermeter.operators.simulate import Answerer, answers, self_consistency as vote_share
from tiermeter.plans.adapters import FACTS_SQL, REPLIES_SQL, decisions, facts, replies, table
from tiermeter.plans.registry import query, r9
from tiermeter.sources import calls, ledger, tasks
from tiermeter.schema import DECISION
from tiermeter.sources.tables import kept, shared_dir
from tiermeter.streaming.runner import Runner, failure_streak as streak, todo


def said(spark: SparkSession, d: str) -> DataFrame:
    return replies(table(spark, d, "conversations"))


# --- confidence ----------------------------------------------------------------------


@query(f"""WITH {FACTS_SQL} SELECT event_id, greatest(0.15e0, CASE WHEN score >= 0.5e0 AND score < 0.9e0 THEN 0.5e0 WHEN score >= 0.9e0 AND score <= 1.0e0 THEN 0.2e0 ELSE 0.1e0 END) AS prob FROM facts""")
def inclusion_prob(spark, d):
    f = facts(table(spark, d, "events"))
    return f.select("event_id", band_prob(F.col("score"), 0.1, [(0.5, 0.9, 0.5), (0.9, 1.0, 0.2)], 0.15).alias("prob"))


@query("""SELECT o_orderkey, CAST(('0x' || sha256('7|run|' || o_orderkey)[1:16]) AS UBIGINT)::DOUBLE / 18446744073709551616.0e0 AS u,
  CAST(('0x' || sha256('7|run|' || o_orderkey)[1:16]) AS UBIGINT)::DOUBLE / 18446744073709551616.0e0 < 0.25e0 AS drawn FROM orders""")
def sha_draw(spark, d):
    u = uniform_draw(F.lit("7"), F.lit("run"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", u.alias("u"), (u < 0.25).alias("drawn"))


@query(f"""WITH {REPLIES_SQL} SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 0.5e0 WHEN 3 THEN NULL ELSE CAST(((conv_id * 13 + turn * 29) % 101)::DOUBLE / 100 AS DOUBLE) END AS confidence FROM replies""")
def verbal_parse(spark, d):
    """As written, with a remark, on a later line with a dash, and with words that leave it open."""
    t = F.col("turn") % 4
    reply = F.concat("reply", F.when(t == 1, " (fairly sure).").when(t == 2, "\n**My confidence** — 5 out of 10").when(t == 3, " or so, maybe").otherwise(""))
    return said(spark, d).select("conv_id", "turn", exprs.verbal_confidence(reply).alias("confidence"))


@query("SELECT item_id, (item_id * 37 % 1000)::DOUBLE / 1000 AS p FROM benchmark")
def monitor_parse(spark, d):
    b = table(spark, d, "benchmark")
    reply = F.concat(F.lit("It seems right.\nP(correct) = "), F.format_string("%.3f", (F.col("item_id") * 37 % 1000) / F.lit(1000.0)))
    return b.select("item_id", exprs.verbal_confidence(reply, monitor=True).alias("p"))


_LOG = "SELECT vec_id, list_transform(embedding, lambda x: -abs(x::DOUBLE)) AS lp FROM embeddings"


def logprobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"))


@query(f"SELECT vec_id, round(list_avg(list_transform(lp, lambda x: exp(x))), 9) AS c FROM ({_LOG})")
def logprob_mean(spark, d):
    return logprobs(spark, d).select("vec_id", r9(exprs.logprob_confidence(F.col("lp"), "mean")).alias("c"))


@query(f"SELECT vec_id, round(exp(list_min(lp)), 9) AS c FROM ({_LOG})")
def logprob_min(spark, d):
    return logprobs(spark, d).select("vec_id", r9(exprs.logprob_confidence(F.col("lp"), "min")).alias("c"))


@query(f"SELECT vec_id, round(exp(list_avg(lp)), 9) AS c FROM ({_LOG})")
def logprob_geo(spark, d):
    return logprobs(spark, d).select("vec_id", r9(exprs.logprob_confidence(F.col("lp"), "geo_mean")).alias("c"))


@query("""SELECT l_orderkey, round((1 + count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE / (1 + count(*)), 9) AS c FROM lineitem GROUP BY l_orderkey""")
def self_consistency(spark, d):
    """The share of an order's lines that agree with a first answer of R."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("votes"))  # an order's few lines
    return v.select("l_orderkey", r9(vote_share(F.col("votes"), F.lit("R"))).alias("c"))


def _three(spark: SparkSession, d: str) -> DataFrame:
    f = facts(table(spark, d, "events"))
    return f.select("event_id", "score", (F.col("h1") / F.lit(1000.0)).alias("b"), F.when(F.col("h3") < 900, F.col("h3") / F.lit(1000.0)).alias("c"))


@query(f"WITH {FACTS_SQL} SELECT event_id, round(CASE WHEN h3 < 900 THEN (score + h1 / 1000.0e0 + h3 / 1000.0e0) / 3 END, 9) AS c FROM facts")
def combine_mean(spark, d):
    return _three(spark, d).select("event_id", r9(exprs.combined([F.col("score"), F.col("b"), F.col("c")])).alias("c"))


@query(f"""WITH {FACTS_SQL} SELECT event_id, round((coalesce(score * 2, 0) + h1 / 1000.0e0 + coalesce(CASE WHEN h3 < 900 THEN h3 / 1000.0e0 * 3 END, 0))
  / ((CASE WHEN score IS NULL THEN 0 ELSE 2 END) + 1.0e0 + (CASE WHEN h3 < 900 THEN 3 ELSE 0 END)), 9) AS c FROM facts""")
def combine_weighted(spark, d):
    return _three(spark, d).select("event_id", r9(exprs.combined([F.col("score"), F.col("b"), F.col("c")], "weighted", [2, 1, 3], ignore_missing=True)).alias("c"))


@query(f"WITH {FACTS_SQL} SELECT event_id, CASE WHEN h3 < 900 AND score IS NOT NULL THEN least(score, h1 / 1000.0e0, h3 / 1000.0e0) END AS lo, greatest(score, h1 / 1000.0e0, CASE WHEN h3 < 900 THEN h3 / 1000.0e0 END) AS hi FROM facts")
def combine_extremes(spark, d):
    three = [F.col("score"), F.col("b"), F.col("c")]
    return _three(spark, d).select("event_id", exprs.combined(three, "min").alias("lo"), exprs.combined(three, "max", ignore_missing=True).alias("hi"))


# --- prices ---------------------------------------------------------------------------


def price_table(spark: SparkSession) -> DataFrame:
    rows = [("alpha-1", 2.0, 10.0, 0.2, 2.5, 0), ("alpha-1", 4.0, 20.0, None, None, 40), ("beta-2", 1.0, 5.0, None, None, 0)]
    return spark.createDataFrame(rows, "model string, input double, output double, cache_read double, cache_write double, from_tokens long")


def usage(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    model = F.element_at(F.array(*[F.lit(m) for m in ("alpha-1", "vendor/alpha-1", "vendor:beta-2-20250101", "gamma")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return line.select("l_orderkey", "l_linenumber", model.alias("model"), F.struct(q.alias("input_tokens"), (q * 2).alias("output_tokens"), (q % 7).alias("cache_read_tokens"), (q % 3).alias("cache_write_tokens")).alias("usage"))


@query("""SELECT l_linenumber, count(*) AS n, round(sum(CASE l_linenumber % 4 WHEN 3 THEN NULL WHEN 2 THEN (q + 10 * q + q % 7 + q % 3) / 1e6::DOUBLE
    ELSE CASE WHEN q + q % 7 + q % 3 > 40 THEN (4 * q + 40 * q + 4 * (q % 7) + 4 * (q % 3)) / 1e6::DOUBLE ELSE (2 * q + 20 * q + 0.2e0 * (q % 7) + 2.5e0 * (q % 3)) / 1e6::DOUBLE END END), 9) AS cost
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_linenumber""")
def pricing_cost(spark, d):
    """Token costs with cache prices and a card for long prompts."""
    return pricing.priced(usage(spark, d), price_table(spark)).groupBy("l_linenumber").agg(F.count("*").alias("n"), r9(F.sum("cost_usd")).alias("cost"))


@query("""SELECT CASE l_linenumber % 4 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'alpha-1' WHEN 2 THEN 'beta-2' END AS price_name, count(*) AS n FROM lineitem GROUP BY ALL""")
def model_lookup(spark, d):
    return pricing.lookup(usage(spark, d), price_table(spark)).groupBy("price_name").agg(F.count("*").alias("n"))


# --- texts --------------------------------------------------------------------------------


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, reference AS answer, TRUE AS same FROM replies")
def final_line_fast(spark, d):
    a = text.final_line_fast(F.col("reply"))
    return said(spark, d).select("conv_id", "turn", a.alias("answer"), (a == F.col("reference")).alias("same"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, reference AS answer FROM replies")
def final_line(spark, d):
    return said(spark, d).select("conv_id", "turn", text.extract(F.col("reply"), "final_line").alias("answer"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, CAST((conv_id * 13 + turn * 29) % 101 AS VARCHAR) AS number FROM replies")
def last_number_fast(spark, d):
    return said(spark, d).select("conv_id", "turn", text.last_number_fast(F.col("reply")).alias("number"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, reference AS number FROM replies")
def last_number(spark, d):
    """The last number outside the confidence line: the answer's."""
    return said(spark, d).select("conv_id", "turn", text.extract(F.col("reply"), "last_number").alias("number"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def regex_extract(spark, d):
    return table(spark, d, "pages").select("page_id", text.extract(F.col("html"), "regex", pattern="<title>([^<]*)</title>", which="first").alias("title"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", text.extract(F.col("props"), "json_field", field="k").alias("k"))


@query(rf"""WITH {REPLIES_SQL}, evened AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(reply), '[''’ʼ`´]', '', 'g'), '(\p{{L}})\.(\p{{L}})', '\1\2', 'g'), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM replies)
SELECT conv_id, turn, contains(' ' || regexp_replace(words, '^(a|an|the) ', '') || ' ', ' the ') AS hit FROM evened""")
def contains_cmp(spark, d):
    """Every reply by the comparator, which evens out case, punctuation and the leading article."""
    return said(spark, d).select("conv_id", "turn", text.compare(F.col("reply"), F.lit("the"), "contains").alias("hit"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, trim(regexp_extract(reply, 'ANSWER: ([^\\n]*)', 1)) = CAST(conv_id % 1000 AS VARCHAR) AS equal FROM replies")
def exact_cmp(spark, d):
    a = text.final_line_fast(F.col("reply"))
    return said(spark, d).select("conv_id", "turn", text.compare(a, (F.col("conv_id") % 1000).cast("string"), "exact").alias("equal"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS verdict FROM replies")
def verdict_parse(spark, d):
    t = F.col("turn") % 3
    reply = F.concat("reply", F.when(t == 0, "\n**VERDICT:** equivalent").when(t == 1, "\nVERDICT: EQUIVALENT\nVERDICT: NOT EQUIVALENT").otherwise("\nno verdict"))
    return said(spark, d).select("conv_id", "turn", exprs.verdict(reply).alias("verdict"))


@query(f"""WITH {REPLIES_SQL}, l AS (SELECT conv_id, unnest(string_split(reply, chr(10))) AS line FROM replies) SELECT count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '^CONFIDENCE: ')) AS confidence_lines FROM l""")
def conf_line_filter(spark, d):
    lines = said(spark, d).select(F.explode(F.split("reply", "\n")).alias("line"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(text.states_confidence(F.col("line"))).alias("confidence_lines"))


@query("""SELECT o_orderkey, ((o_orderkey % 50 + 3) * (o_orderkey % 7 + 2) - o_orderkey % 11)::DOUBLE AS result FROM orders""")
def apply_ops_fold(spark, d):
    k = F.col("o_orderkey")
    step = lambda op, v: F.struct(F.lit(op).alias("op"), v.cast("double").alias("value"))
    return table(spark, d, "orders").select("o_orderkey", exprs.apply_ops(k % 50, F.array(step("add", F.lit(3)), step("mul", k % 7 + 2), step("sub", k % 11))).alias("result"))


@query("SELECT o_orderkey, CAST(CAST(floor(o_orderkey % 50 * (o_orderkey % 7 + 2) / CAST(o_orderkey % 11 + 1 AS DOUBLE)) AS BIGINT) * 3 / 3 AS DOUBLE) + o_orderkey % 50 AS result FROM orders")
def apply_ops_division(spark, d):
    """Floored and even divisions."""
    k = F.col("o_orderkey")
    step = lambda op, value: F.struct(F.lit(op).alias("op"), value.cast("double").alias("value"))
    steps = F.array(step("mul", k % 7 + 2), step("floordiv", k % 11 + 1), step("mul", F.lit(3)), step("div", F.lit(3)), step("add", k % 50))
    return table(spark, d, "orders").select("o_orderkey", exprs.apply_ops(k % 50, steps).alias("result"))


@query("SELECT item_id, replace('Q: {prompt} Again: {prompt}', '{prompt}', text) AS rendered FROM benchmark")
def template_render(spark, d):
    return table(spark, d, "benchmark").select("item_id", exprs.render("Q: {prompt} Again: {prompt}", F.col("text")).alias("rendered"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0e0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", exprs.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {REPLIES_SQL} SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE substr('ABCD', CAST(turn % 4 + 1 AS INTEGER), 1) END AS letter FROM replies")
def choice_extract(spark, d):
    """One letter in seven spellings; the last has none."""
    letter = F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("turn") % 4 + 1).cast("int"))
    said_so = ["I considered each.\nThe answer is ({}).", "A man saw it. The answer would be {}.", "**Answer: {}**\nConfidence: 0.8", "so it is \\boxed{{\\text{{{}}}}}", "Why\n({})", "(A) 1\n(B) 2\n(C) 3\n(D) 4\nANSWER: {}.", "A man walks into a bar"]
    reply = F.lit("")
    for k, form in enumerate(said_so):
        before, _, after = form.replace("{{", "\x00").replace("}}", "\x01").partition("{}")
        parts = [F.lit(x.replace("\x00", "{").replace("\x01", "}")) for x in (before, after)]
        reply = F.when(F.col("turn") % len(said_so) == k, F.concat(parts[0], letter, parts[1]) if "{}" in form.replace("{{", "").replace("}}", "") else parts[0]).otherwise(reply)
    return said(spark, d).select("conv_id", "turn", text.extract(reply, "choice").alias("letter"))


@query(r"""WITH evened AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[''’ʼ`´]', '', 'g'), '(\p{L})\.(\p{L})', '\1\2', 'g'), '(\d),(\d\d\d)', '\1\2', 'g'), '\p{P}', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM benchmark)
SELECT item_id, regexp_replace(words, '^(a|an|the) ', '') AS normalized FROM evened""")
def normalize_texts(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.normalize(F.col("text")).alias("normalized"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 2 AS equal FROM lineitem")
def numeric_cmp(spark, d):
    """One number in two spellings; every third line's differ by one."""
    n = F.col("l_quantity").cast("long")
    off = (n + F.when(F.col("l_linenumber") % 3 == 2, 1).otherwise(0)).cast("string")
    n = n.cast("string")
    kind = F.col("l_linenumber") % 4
    left = F.when(kind == 0, F.concat(F.lit("$"), n, F.lit(".00"))).when(kind == 1, F.concat(n, F.lit(" apples"))).when(kind == 2, F.concat(F.lit("x = "), n)).otherwise(F.concat(n, F.lit("%")))
    right = F.when(kind == 0, F.concat(off, F.lit(" dollars"))).when(kind == 1, F.concat(off, F.lit(" apple."))).when(kind == 2, F.concat(off, F.lit("e0"))).otherwise(F.concat(off, F.lit("/100")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.compare(left, right, "numeric").alias("equal"))


# --- tasks ---------------------------------------------------------------------------------


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) AS pos, text, item_id FROM benchmark)
SELECT CASE WHEN item_id % 2 = 0 THEN 'own' || item_id ELSE 't' || lpad(CAST(pos AS VARCHAR), 4, '0') END AS id, text AS prompt, CASE WHEN item_id % 3 = 0 THEN CAST(item_id AS VARCHAR) END AS reference FROM b""")
def task_ids(spark, d):
    from pyspark.sql import Window

    b = table(spark, d, "benchmark")
    rows = b.select(F.row_number().over(Window.orderBy("item_id")).cast("long").alias("pos"), "item_id", "text")  # a few hundred prompts
    record = F.to_json(F.struct(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("own"), "item_id")).alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).alias("answer")))
    return tasks.from_records(rows.select("pos", record.alias("record"))).select("id", "prompt", "reference")


@query("""SELECT 'gsm8k-' || lpad(CAST(item_id AS VARCHAR), 4, '0') AS id, CAST(item_id * 1234567 AS VARCHAR) AS reference FROM benchmark""")
def gsm8k_reference(spark, d):
    b = table(spark, d, "benchmark")
    answer = F.concat("text", F.lit("\n#### "), F.format_number(F.col("item_id") * 1234567, 0))
    return tasks.gsm8k(b.select(F.col("item_id").alias("pos"), F.col("text").alias("question"), answer.alias("answer"))).select("id", "reference")


@query("SELECT CASE WHEN item_id % 5 > 0 THEN CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END END AS level, count(*) AS tasks, count(CASE WHEN item_id % 3 > 0 THEN 1 END) AS with_reference FROM benchmark GROUP BY 1")
def task_levels(spark, d):
    """The summary of a task file: its levels, and how many tasks have a reference."""
    level = F.when(F.col("item_id") % 5 > 0, F.when(F.length("text") < 200, "short").otherwise("long"))
    t = table(spark, d, "benchmark").select(F.to_json(F.struct(level.alias("level"), "item_id")).alias("meta"), F.when(F.col("item_id") % 3 > 0, F.col("item_id").cast("string")).alias("reference"))
    return tasks.levels(t)


@query("SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 400 THEN 'middle' ELSE 'long' END AS level, count(*) AS n FROM benchmark GROUP BY 1")
def dataset_levels(spark, d):
    size = F.length("text")
    return table(spark, d, "benchmark").groupBy(F.when(size < 200, "short").when(size < 400, "middle").otherwise("long").alias("level")).agg(F.count("*").alias("n"))


@query()
def arithmetic_tasks(spark, d):
    t = tasks.arithmetic(spark, 200)
    return t.select("id", "reference", (exprs.apply_ops(F.col("start"), F.col("ops")).cast("long").cast("string") == F.col("reference")).alias("folds"))


# --- joins over logs and calls --------------------------------------------------------------------


def as_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a log: every tenth order was recorded twice, the later time with another status."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"), F.col("o_orderkey").alias("seq"))
    again = o.where("task_id % 10 = 0").select("task_id", F.lit("again").alias("status"), F.lit(2).alias("version"), (F.col("seq") + 1_000_000_000).alias("seq"))
    return o.unionByName(again)


@query("SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 10 = 0 THEN 'again' ELSE o_orderstatus END AS status, o_orderkey AS seq FROM orders")
def ledger_upsert(spark, d):
    """The last version of each decision, in the place of its first."""
    return ledger.upserted(as_log(spark, d), ["task_id"], "version", "seq").select("task_id", "status", "seq")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus <> 'F')")
def resume_anti(spark, d):
    o = table(spark, d, "orders")
    done = o.where("o_orderkey % 3 = 0 and o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("task_id"))
    return todo(o.select(F.col("o_orderkey").alias("id")), done)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
def retried_semi(spark, d):
    o = table(spark, d, "orders")
    failed = o.where("o_orderkey % 3 = 0 and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return o.select(F.col("o_orderkey").alias("id")).join(failed, "id", "left_semi")


@query("SELECT l_partkey % 100 AS prompt, count(*) AS n, count(*) FILTER (WHERE l_partkey % 100 < 40) AS cached, CASE WHEN l_partkey % 100 < 40 THEN 'old' ELSE 'new' END || (l_partkey % 100) AS text FROM lineitem GROUP BY l_partkey % 100")
def cache_join(spark, d):
    """Requests answered from a cache, the distinct missing ones by one call each."""
    r = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("prompt"))
    key = calls.request_key(F.lit("b"), prompt=F.col("prompt").cast("string"))
    cache = spark.range(40).select(calls.request_key(F.lit("b"), prompt=F.col("id").cast("string")).alias("key"), F.concat(F.lit("old"), "id").alias("text"))
    answer = lambda m: m.select("key", F.concat(F.lit("new"), "prompt").alias("text"), F.lit(None).cast("string").alias("error"))
    got, _ = calls.with_cache(r.withColumn("key", key), cache, answer)
    return got.groupBy("prompt", "text").agg(F.count("*").alias("n"), F.count_if("cached").alias("cached"))


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN 'by key' WHEN o_orderkey % 3 = 0 THEN 'by tier' WHEN o_orderkey % 2 = 0 THEN 'by task' END AS text FROM orders""")
def replay_lookup(spark, d):
    k = F.col("o_orderkey")
    req = table(spark, d, "orders").select(F.concat(F.lit("k"), k).alias("key"), k.alias("task_id"), F.lit("fast").alias("tier"))
    nothing = F.lit(None).cast("string")
    rec = req.where("task_id % 5 = 0").select("key", F.lit(None).cast("long").alias("task_id"), nothing.alias("tier"), F.lit("by key").alias("text"))
    rec = rec.union(req.where("task_id % 3 = 0").select(nothing, "task_id", "tier", F.lit("by tier"))).union(req.where("task_id % 2 = 0").select(nothing, "task_id", nothing, F.lit("by task")))
    return calls.replay(req, rec).select("task_id", "text")


def new_ledger(spark: SparkSession) -> ledger.Ledger:
    return ledger.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def as_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 7919 % 1000).alias("created"))


@query("SELECT max_by(c_custkey, (c_custkey * 7919 % 1000) * 1000000 + c_custkey) AS run_id FROM customer")
def latest_run(spark, d):
    """The run that a ledger takes where none is named."""
    book = new_ledger(spark)
    runs = as_runs(spark, d).select(F.col("run_id").cast("string").alias("run_id"), F.lpad(F.col("created").cast("string"), 4, "0").alias("created_at"), F.lit("serve").alias("mode"), F.lit("{}").alias("config"), F.lit("").alias("note"), F.col("run_id").alias("version"))
    runs.write.parquet(f"{book.path}/runs")
    return spark.createDataFrame([(int(book.latest_run_id()),)], "run_id long")


@query("SELECT CAST(k AS VARCHAR) AS run_id, count(DISTINCT o_orderkey) AS n FROM range(17) r(k) LEFT JOIN orders ON o_custkey % 16 = k GROUP BY k")
def ledger_runs(spark, d):
    """A ledger's runs with their decisions, some of them recorded twice; one run has none."""
    book = new_ledger(spark)
    runs = spark.range(17).select(F.col("id").cast("string").alias("run_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("created_at"), F.lit("serve").alias("mode"), F.lit("{}").alias("config"), F.lit("").alias("note"), F.col("id").alias("version"))
    runs.write.parquet(f"{book.path}/runs")
    made = table(spark, d, "orders").select((F.col("o_custkey") % 16).cast("string").alias("run_id"), F.col("o_orderkey").alias("seq"), F.struct(F.col("o_orderkey").cast("string").alias("id")).alias("task"))
    made = made.to(T._parse_datatype_string(DECISION))
    book.record(made)
    book.record(made.where("seq % 3 = 0"))
    return book.runs().select("run_id", "n")


@query("SELECT c_custkey AS run_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def runs_with_counts(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("n"))
    return as_runs(spark, d).select("run_id").join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {FACTS_SQL} SELECT task_id FROM facts WHERE accepted AND event_id % 67 <> 0 AND u < pi AND event_id % 53 = 0")
def pending_scan(spark, d):
    """The audits that a recorded run still owes."""
    book = new_ledger(spark)
    x = decisions(table(spark, d, "events")).withColumn("run_id", F.lit("r"))
    book.start_run("r")
    book.record(x)
    return book.pending_audits("r").select(F.col("task.id").alias("task_id"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) AS n FROM e WHERE bad GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS run_id, max(n) AS streak FROM r GROUP BY user_id""")
def failure_streak(spark, d):
    """The longest run of failures, one user's events taken as a run."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "e").alias("error"))
    return streak(e)


@query("""WITH m AS (SELECT d.doc_id AS request_id, b.item_id AS task_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(b.text) DESC, b.item_id DESC) AS n
FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT request_id, task_id FROM m WHERE n = 1""")
def prompts_in_documents(spark, d):
    """For each document the longest benchmark text that it holds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("request"))
    return longest_contained(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt")))


@query("""WITH r AS (SELECT item_id AS request_id, 'Please answer: ' || text || ' Thanks.' AS request FROM benchmark), t AS (SELECT item_id AS task_id, text AS prompt FROM benchmark),
m AS (SELECT request_id, task_id, row_number() OVER (PARTITION BY request_id ORDER BY length(prompt) DESC, task_id DESC) AS n FROM r JOIN t ON contains(request, prompt)) SELECT request_id, task_id FROM m WHERE n = 1""")
def prefix_match_topk(spark, d):
    """The task whose prompt is the longest that a request contains."""
    b = table(spark, d, "benchmark")
    req = b.select(F.col("item_id").alias("request_id"), F.concat(F.lit("Please answer: "), "text", F.lit(" Thanks.")).alias("request"))
    return longest_contained(req, b.select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt")))


@query("SELECT item_id, 'p-' || item_id AS task_id, 1.0e0 / (1.0e0 + exp(-(3.0e0 - (item_id % 7)::DOUBLE))) AS p, (CAST(('0x' || sha256('0|fast|p-' || item_id || '|0|correct')[1:16]) AS UBIGINT)::DOUBLE + 0.5e0) / 18446744073709551616.0e0 < 1.0e0 / (1.0e0 + exp(-(3.0e0 - (item_id % 7)::DOUBLE))) AS correct FROM benchmark")
def simulated_draws(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("p-"), "item_id").alias("task_id"))
    p = exprs.sigmoid(F.lit(3.0) - (F.col("item_id") % 7).cast("double"))
    return b.select("item_id", "task_id", p.alias("p"), (Answerer("fast").draw(F.col("task_id"), F.lit(0), "correct") < p).alias("correct"))


def sim_tasks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents")
    return b.select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("prompt"), (F.col("n_chars") % 97).cast("string").alias("reference"), F.lit(None).cast("string").alias("meta"), (F.col("doc_id") % 7).cast("double").alias("difficulty"))


TIERS = (Tier("fast", Answerer("fast", skill=3.0, overconfidence=0.05), 0.7), Tier("slow", Answerer("slow", skill=6.0, input_price=5.0, output_price=25.0)))


@query()
def simulated_answers(spark, d):
    return answers(sim_tasks(spark, d), TIERS[0].backend).select("id", "answer", "right", r9("score").alias("score"))


@query()
def simulated_cascade(spark, d):
    """A two-tier served run with inline audits, and its summary's main figures."""
    dec = kept(route(sim_tasks(spark, d), TIERS, "sim", audit=AuditPolicy(rate=0.3)), "decisions")
    s = audit.summarize(dec, 0.1)
    e = s.disagreement
    return spark.createDataFrame([(s.n_decisions, s.n_skipped, s.n_audited, e.value if e else None, s.skipped_error.value if s.skipped_error else None, s.status)], "n_decisions long, n_skipped long, n_audited long, disagreement double, skipped_error double, status string")


@query()
def streaming_resume(spark, d):
    """A streamed run stopped half way and started again: every task has one decision."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t = sim_tasks(spark, d)
    t.where("seq % 2 = 0").write.json(f"{root}/in/a")
    book = ledger.Ledger(spark, f"{root}/ledger")
    run = Runner(book, TIERS, "s", audit=AuditPolicy(rate=0.3))
    run.stream(spark, f"{root}/in/*", f"{root}/state").awaitTermination()
    t.where("seq % 4 <> 0").write.json(f"{root}/in/b")
    run.stream(spark, f"{root}/in/*", f"{root}/state").awaitTermination()
    got = book.decisions("s")
    return got.agg(F.count("*").alias("decisions"), F.count_distinct("task.id").alias("tasks"), F.count_if("escalated").alias("escalated"))


