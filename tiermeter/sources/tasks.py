"""Task files: JSONL, JSON and CSV to tasks, and back."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Names of a record's prompt and reference, first present wins.
PROMPTS = ("prompt", "question", "input")
REFERENCES = ("reference", "answer", "target", "label")


def number_text(json_text: Column) -> Column:
    """A JSON scalar as text: whole floats without a point, strings without quotes, null as null."""
    plain = F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")
    whole = F.regexp_extract(json_text, r"^(-?\d+)\.0+$", 1)
    return F.when(json_text == "null", F.lit(None)).when(whole != "", whole).otherwise(plain)


def _first_present(record: Column, names: tuple[str, ...]) -> Column:
    """The name of the first field that the record has, even if it is null."""
    keys = F.json_object_keys(record)
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), n).otherwise(out)
    return out


def from_records(records: DataFrame, from_csv: bool = False, limit: int | None = None, checked: bool = True) -> DataFrame:
    """Tasks (``id``, ``prompt``, ``reference``, ``meta``) from (``pos``, ``record``) rows of JSON objects.

    Missing ids become ``t0001`` and so on by position; repeated ids, records
    without a prompt and empty prompts are errors. Fields that are neither id,
    prompt nor reference go to ``meta``, over those of an inner ``meta``.
    """
    if limit is not None:
        records = records.orderBy("pos").limit(limit)
    r = F.col("record")
    if from_csv:  # empty cells carry nothing for ids and references
        empty = F.array(*[F.lit(k) for k in ("id", *REFERENCES)])
        r = F.to_json(F.map_filter(F.from_json(r, "map<string,string>"), lambda k, v: ~(F.array_contains(empty, k) & (v == ""))))
        records = records.withColumn("record", r)
        r = F.col("record")
    d = records.withColumn("pk", _first_present(r, PROMPTS)).withColumn("rk", _first_present(r, REFERENCES))
    fields = F.from_json(r, "map<string,string>")
    d = d.withColumn("f", fields)
    prompt, given = F.element_at("f", F.col("pk")), F.try_element_at("f", F.lit("id"))
    if checked:
        bad = F.col("pk").isNull() | (F.trim(F.coalesce(F.try_element_at("f", F.col("pk")), F.lit(""))) == "")
        d = d.where(F.assert_true(~bad, F.concat(F.lit("record "), F.col("pos").cast("string"), F.lit(": no prompt"))).isNull())
    used = F.array("pk", "rk", F.lit("id"), F.lit("meta"))
    inner = F.from_json(F.try_element_at("f", F.lit("meta")), "map<string,string>")
    rest = F.map_filter("f", lambda k, v: ~F.coalesce(F.array_contains(F.array_compact(used), k), F.lit(False)))
    kept = F.map_filter(F.coalesce(inner, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.map_contains_key(rest, k))
    ref = F.when(F.col("rk").isNotNull(), F.try_element_at("f", F.col("rk")))
    whole = F.regexp_extract(ref, r"^(-?\d+)\.0+$", 1)
    d = d.select("pos", given.alias("given"), prompt.alias("prompt"), F.when(whole != "", whole).otherwise(ref).alias("reference"), F.to_json(F.map_concat(kept, rest)).alias("meta"))
    out = with_ids(d)
    if checked:
        twice = Window.partitionBy("id")
        out = out.withColumn("__n", F.count("*").over(twice)).where(F.assert_true(F.col("__n") == 1, F.concat(F.lit("repeated id "), F.col("id"))).isNull()).drop("__n")
    return out


def with_ids(d: DataFrame) -> DataFrame:
    """Ids by position where none are given; the width follows the number of records."""
    total = d.agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(4), F.length(F.col("n").cast("string")))
    own = F.concat(F.lit("t"), F.lpad(F.col("pos").cast("string"), width, F.lit("0")))
    return d.crossJoin(F.broadcast(total)).select("pos", F.coalesce("given", own).alias("id"), "prompt", "reference", "meta")  # one row of totals


#: Where a row was read: its file and the start of the split.
SPLIT = ("__file", "__from")


def with_split(rows: DataFrame) -> DataFrame:
    """Rows as a file source gives them, with the split that they come from."""
    return rows.select("*", *[F.col(f"_metadata.{c}").alias(name) for c, name in zip(("file_path", "file_block_start"), SPLIT, strict=True)])


def positions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of ``with_split`` numbered from 1 in the order of file names and lines, without bringing them into one task.

    A task reads a split from its start to its end, so a row's number is its number
    within its split after the counts of the splits before it.
    """
    tagged = lines.withColumn("__id", F.monotonically_increasing_id())
    sizes = tagged.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*SPLIT, "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__b"))  # a row for each split
    return tagged.join(before, list(SPLIT)).select((F.col("__id") - F.col("__first") + F.col("__b") + 1).alias("pos"), F.col(column))


def load_tasks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tasks of a ``.jsonl``, ``.json`` or ``.csv`` file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        lines = with_split(spark.read.text(path)).where(F.trim(F.regexp_replace("value", "^﻿", "")) != "")
        rows = positions(lines).select("pos", F.regexp_replace("value", "^﻿", "").alias("record"))
        bad = F.from_json("record", "map<string,string>").isNull()
        rows = rows.where(F.assert_true(~bad, F.concat(F.lit(f"{path}:"), F.col("pos").cast("string"), F.lit(": not a JSON object"))).isNull())
        return from_records(rows, limit=limit)
    if kind == "json":
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
        inner = F.coalesce(F.get_json_object("v", "$.tasks"), F.col("v"))
        rows = text.select(F.posexplode(F.from_json(inner, "array<string>")).alias("p", "record")).select((F.col("p") + 1).alias("pos"), "record")
        return from_records(rows, limit=limit)
    if kind == "csv":
        form = {"header": True, "multiLine": True, "escape": '"'}
        given = spark.read.csv(path, **form).columns
        names = [n.strip() for n in given]
        if len(set(names)) < len(names):
            raise ValueError(f"{path}: repeated header")
        odd = "__odd"  # a row with another number of cells, as it stands: short ones are padded, long ones are errors
        schema = StructType([StructField(n, StringType()) for n in [*given, odd]])
        df = spark.read.schema(schema).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=odd, enforceSchema=False, **form)
        cells = F.size(F.split(F.regexp_replace(odd, '"[^"]*"', ""), ","))
        df = df.where(F.assert_true(F.coalesce(cells <= len(names), F.lit(True)), F.lit(f"{path}: too many cells in a row")).isNull())
        df = with_split(df).drop(odd).toDF(*names, *SPLIT).fillna("", names)
        df = df.where(F.concat_ws("", *[F.trim(f"`{n}`") for n in names]) != "")
        rows = positions(df.select(*SPLIT, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("record")), "record")
        return from_records(rows, from_csv=True, limit=limit)
    raise ValueError(f"{path}: tasks come from .jsonl, .json or .csv files")


def save_tasks(tasks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    tasks.select(F.to_json(F.struct("id", "prompt", "reference", "meta")).alias("value")).write.text(path)


def gsm8k(rows: DataFrame) -> DataFrame:
    """(``pos``, ``question``, ``answer``) rows: what follows the last ``####`` is the reference."""
    pattern = r"(?s)^(.*)####(.*)$"
    ref = F.regexp_replace(F.trim(F.regexp_extract("answer", pattern, 2)), ",", "")
    solution = F.trim(F.regexp_extract("answer", pattern, 1))
    return rows.select(F.concat(F.lit("gsm8k-"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("id"), F.col("question").alias("prompt"), ref.alias("reference"), F.to_json(F.struct(F.lit("gsm8k").alias("source"), solution.alias("solution"))).alias("meta"))


def arithmetic(spark: SparkSession, n: int, seed: int = 0, min_steps: int = 1, max_steps: int = 6) -> DataFrame:
    """Chained whole-number problems whose values stay within 1 to 5000, each from its own seed.

    A task's random numbers come from its position, not from a stream shared by
    all tasks, so any number of tasks can be made in parallel.
    """
    if not 1 <= min_steps <= max_steps:
        raise ValueError("need 1 <= min_steps <= max_steps")

    def make(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = random.Random(f"{seed}|{k}")
                steps = rng.randint(min_steps, max_steps)
                value = start = rng.randint(2, 60)
                ops = []
                while len(ops) < steps:
                    op, by = rng.choice(("add", "sub", "mul", "div")), rng.randint(2, 30)
                    new = {"add": value + by, "sub": value - by, "mul": value * by, "div": value // by if value % by == 0 else 0}[op]
                    if 1 <= new <= 5000:
                        ops.append((op, by))
                        value = new
                said = ", ".join(f"{o} {b}" for o, b in ops)
                out.append((k + 1, f"a{k + 1:05d}", f"Start with {start}, then {said}. What is the result?", str(value), start, [{"op": o, "value": float(b)} for o, b in ops], steps))
            yield pd.DataFrame(out, columns=["pos", "id", "prompt", "reference", "start", "ops", "steps"])

    return spark.range(n).mapInPandas(make, "pos long, id string, prompt string, reference string, start long, ops array<struct<op:string,value:double>>, steps int")


GENERATORS: dict[str, Callable[..., DataFrame]] = {"arithmetic": arithmetic}


def make(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](spark, **options)


def levels(tasks: DataFrame) -> DataFrame:
    """``level`` (of ``meta``, null where none is given), its ``tasks`` and those of them ``with_reference``."""
    return tasks.groupBy(F.get_json_object("meta", "$.level").alias("level")).agg(F.count("*").alias("tasks"), F.count("reference").alias("with_reference"))
