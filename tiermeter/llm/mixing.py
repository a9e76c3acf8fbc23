"""Mixing sources to target weights by Poisson replication (op 9).

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import written
from tiermeter.llm.graph import hot_join

#: Target shares are proportional to a source's bytes to this power, unless weights are given.
FLATTEN = 0.5
#: Sources up to this many are broadcast, with their distributions; of more only those with many rows.
BROADCAST_SOURCES = 10_000
SEED = 7
#: The highest rate of one draw; a higher rate is a sum of independent draws.
MAX_RATE = 500.0
#: Copies that one array lists.
BLOCK = 1 << 16


def uniform(key: Column, salt: str | Column) -> Column:
    """A number in [0, 1) of 52 bits from SHA-256; DuckDB gives the same."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.conv(F.substring(F.sha2(F.concat(salt, F.lit("|"), key), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """``source``, its ``rows`` and ``rate``, its number of ``draws`` and the Poisson distribution function of one up to where it is 1.

    A source's rate makes its expected bytes its share of ``epochs`` times all
    bytes. A null source is a source of its own. Sources without bytes keep
    rate ``epochs``. Rates above ``MAX_RATE`` are split evenly over several
    draws, as the function of a higher one would start from 0. Sources missing from ``weights`` have weight 0.
    """
    n = F.sum(F.octet_length("text").cast("long"))
    # A row for each source; written, so that the documents are read once for it.
    sizes = written(docs.groupBy("source").agg(F.coalesce(n, F.lit(0).cast("long")).alias("bytes"), F.count("*").alias("rows")), "sources")
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(FLATTEN))
    else:
        weight = F.lit(0.0)
        for name, value in sorted(weights.items()):
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    # decimals add up to the same in any order
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.col("weight").cast("decimal(30,6)")).cast("double").alias("all_weight"))
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.lit(epochs) * F.col("all_bytes") / F.col("bytes")).otherwise(F.lit(float(epochs)))
    found = sizes.crossJoin(F.broadcast(total)).select("source", "rows", rate.alias("rate"))  # total has one row
    found = found.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int")))
    one = F.col("rate") / F.col("draws")
    steps = F.sequence(F.lit(1), F.ceil(one + 12 * F.sqrt(one) + 20).cast("int"))
    first = F.exp(-one)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * one / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return found.withColumn("cdf", F.aggregate(steps, start, step, lambda acc: acc["cdf"]))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """Each row as often as its Poisson draw says, with ``replica`` (from 0), ``rate`` and ``shuffle_key``.

    The draw inverts the distribution at a uniform number from the seed and
    ``doc_id``, so rows that share an id are drawn alike, and so are null ids.
    Where the rate takes several draws, each has a seed of its own and they add up.
    With ``shuffle`` the copies are dealt to partitions and sorted there by
    ``shuffle_key``, a hash of the id and the replica: a global shuffle that is
    the same on every run. Columns of ``docs`` with these names are replaced.
    An empty table gives no rows; null texts have no bytes.
    """
    docs = docs.drop("replica", "rate", "shuffle_key")
    found = rates(docs, weights, epochs).withColumnsRenamed({"source": "__source", "rows": "__rows", "draws": "__draws", "cdf": "__cdf"})
    n_sources, n_rows = found.agg(F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if n_sources <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("__source")))
    else:  # a hot source is broadcast all the same
        name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias("__name")
        one = written(found.select("*", name("__source")), "rates")
        joined = hot_join(docs.select("*", name("source")), one, "__name", "__rows", n_rows, "inner").drop("__name")
    own_seed = lambda k: F.when(k == 0, F.lit(str(seed))).otherwise(F.concat(F.lit(f"{seed}."), k.cast("string")))
    drawn = F.transform(F.sequence(F.lit(0), F.col("__draws") - 1), lambda k: uniform(key, own_seed(k)))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    # In blocks, so that no array grows with a document's copies.
    blocks = joined.withColumn("__n", count).where("__n > 0").withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / BLOCK).cast("int"))))
    copies = blocks.withColumn("replica", F.explode(F.sequence(F.col("__block") * BLOCK, F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK) - 1)))
    copies = copies.drop("__source", "__rows", "__draws", "__cdf", "__n", "__block").withColumn("shuffle_key", uniform(F.concat(key, F.lit("|"), F.col("replica").cast("string")), f"order{seed}"))
    if not shuffle:
        return copies
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY source
), weighted AS (
  SELECT *, pow(CAST(bytes AS DOUBLE), {FLATTEN!r}::DOUBLE) AS weight FROM sizes
), total AS (
  SELECT sum(bytes)::DOUBLE AS all_bytes, CAST(sum(CAST(weight AS DECIMAL(30,6))) AS DOUBLE) AS all_weight FROM weighted
), rated AS (
  SELECT source, CASE WHEN bytes > 0 AND all_weight > 0 THEN weight / all_weight * 1.0::DOUBLE * all_bytes / bytes ELSE 1.0::DOUBLE END AS rate
  FROM weighted, total
), dealt AS (
  SELECT source, rate, greatest(1, CAST(ceil(rate / {MAX_RATE}::DOUBLE) AS INTEGER)) AS draws FROM rated
), one AS (
  SELECT *, rate / draws AS one FROM dealt
), cdf AS (
  SELECT source, one, 0 AS k, exp(-one) AS p, exp(-one) AS c FROM one
  UNION ALL
  SELECT source, one, k + 1, p * one / (k + 1), c + p * one / (k + 1) FROM cdf
  WHERE k + 1 <= CAST(ceil(one + 12 * sqrt(one) + 20) AS INTEGER)
), numbered AS (
  SELECT *, row_number() OVER () AS n FROM documents
), drawn AS (
  SELECT d.n, d.doc_id, d.source, unnest(generate_series(0, o.draws - 1)) AS j FROM numbered d JOIN one o ON o.source IS NOT DISTINCT FROM d.source
), uniform AS (
  SELECT n, source, CAST(('0x' || substr(sha256('{SEED}' || CASE WHEN j = 0 THEN '' ELSE '.' || j END || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM drawn
), counted AS (
  SELECT n, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM uniform.source AND cdf.c <= uniform.u)) AS BIGINT) AS n_copies FROM uniform GROUP BY n
), copies AS (
  SELECT d.*, o.rate, unnest(generate_series(0, n_copies - 1)) AS replica FROM numbered d JOIN counted USING (n) JOIN one o ON o.source IS NOT DISTINCT FROM d.source WHERE n_copies > 0
)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(replica AS INTEGER) AS replica,
  CAST(('0x' || substr(sha256('order{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(replica AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""
