"""Costs of token usage from a table of prices.

Prices change, so none are built in: a price table is a DataFrame with ``model``,
``input``, ``output`` and, where they differ from the input price, ``cache_read``
and ``cache_write``, all in USD for a million tokens. Rows of the same model with
a ``from_tokens`` above 0 are the cards for longer prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER = 1_000_000.0
#: A table of prices up to this many rows is broadcast.
BROADCAST_ROWS = 50_000


def plain_names(model: Column) -> Column:
    """Names to look for, in order: as given; without provider and version; without a date too."""
    bare = F.regexp_replace(F.regexp_replace(model, r"@[A-Za-z0-9._-]+$", ""), r"-v\d+(?::\d+)?$", "")
    bare = F.regexp_replace(bare, r"^(?:[A-Za-z0-9_-]+[/:])+", "")
    bare = F.regexp_replace(bare, r"^(?:[a-z]{2,6}\.)?[a-z]+\.(?=[a-z])", "")
    return F.array(model, bare, F.regexp_replace(bare, r"-\d{8}$", ""))


def lookup(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``usage`` with the ``price_name`` of the first of its names that has a price, else null."""
    known = prices.select(F.col("model").alias("__m")).distinct()
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    out = usage.withColumn("__names", plain_names(F.col(model)))
    for k in range(3):
        hit = known.withColumnRenamed("__m", f"__m{k}")
        out = out.join(hit, F.get("__names", F.lit(k)) == F.col(f"__m{k}"), "left")
    return out.withColumn("price_name", F.coalesce("__m0", "__m1", "__m2")).drop("__names", "__m0", "__m1", "__m2")


def cost(card: Column, usage: Column, hour_long: Column | None = None) -> Column:
    """Cost of a usage struct on a price struct; null where a price or count is unknown.

    ``hour_long`` counts those cache writes that are kept for an hour, at twice
    the input price.
    """
    read, write = F.coalesce(card["cache_read"], card["input"]), F.coalesce(card["cache_write"], card["input"])
    short = usage["cache_write_tokens"] - (hour_long if hour_long is not None else F.lit(0))
    total = usage["input_tokens"] * card["input"] + usage["output_tokens"] * card["output"] + usage["cache_read_tokens"] * read + short * write
    if hour_long is not None:
        total = total + hour_long * card["input"] * 2
    return total / PER


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (``id``, ``model``, ``usage``) with its ``cost_usd`` on the card for its prompt's length."""
    named = lookup(usage, prices)
    card = prices.select(F.col("model").alias("price_name"), F.coalesce("from_tokens", F.lit(0)).alias("__from"), F.struct("input", "output", "cache_read", "cache_write").alias("__card"))
    size = F.col("usage.input_tokens") + F.col("usage.cache_read_tokens") + F.col("usage.cache_write_tokens")
    cards = card.groupBy("price_name").agg(F.array_sort(F.collect_list(F.struct(F.col("__from").alias("f"), F.col("__card").alias("c")))).alias("__cards"))  # a few cards for each model
    out = named.join(cards, "price_name", "left").withColumn("__fit", F.filter("__cards", lambda x: (x["f"] == 0) | (x["f"] < size)))
    return out.withColumn("cost_usd", cost(F.get("__fit", F.size("__fit") - 1)["c"], F.col("usage"))).drop("__cards", "__fit")


def newest(prices: DataFrame) -> DataFrame:
    """The last row for each model and card, by ``as_of``."""
    w = Window.partitionBy("model", "from_tokens").orderBy(F.desc("as_of"))
    return prices.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
