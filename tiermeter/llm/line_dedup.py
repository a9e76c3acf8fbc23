"""Dropping lines that many documents share (op 13).

Only DataFrame functions: no Python runs on the executors. Lines are exploded,
normalised and hashed to 128 bits; each row of ``docs`` counts a key once, as
``array_distinct`` comes before the explode, so the count needs no distinct and
is summed map-side. Positions to drop come from joining the exploded lines with
the frequent keys, and each text is put together again from the positions left.

Nothing gathers more than one document's positions. Frequent keys are broadcast
while they are at most ``BROADCAST_KEYS``; beyond that only the hot ones are, and
the other lines are shuffled. Texts are joined with their positions by a hash of
the text; hot texts (copies, blank ones) don't take part in that shuffle.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import written
from tiermeter.llm.graph import HOT_KEYS

#: A key in so many documents, of so many code points, loses its lines.
MIN_DOCS, MIN_CHARS = 10, 1
#: Frequent keys up to this many are broadcast (24 bytes each, 6 MB); of more only the hot ones.
BROADCAST_KEYS = 1 << 18
#: Positions of a hot text that is broadcast; adaptive execution splits the partition of one with more.
MOST_DROPS = 1024
#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """A line as it is compared: without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)


def lines_of(text: str) -> Column:
    """The lines of a text, split at line feeds; a null or empty text has one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _hash(column: str | Column) -> list[Column]:
    """Two 64-bit hashes of differing seeds."""
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``k1``, ``k2`` (the hash of a key) and ``n``, its number of documents, for keys found in ``min_docs`` or more.

    Every row counts as a document of its own, whatever its id.
    """
    keys = F.array_distinct(F.transform(lines_of("text"), key_of))
    key = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= max(min_chars, 1))
    k1, k2 = _hash("key")
    return key.groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def dropped_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1``, ``h2`` (the hash of a text), the positions to ``drop`` from it (at least one) and the number of ``rows`` with the text.

    ``frequent`` is a written table.
    """
    h1, h2 = _hash("text")
    line = docs.select(h1.alias("h1"), h2.alias("h2"), F.posexplode(F.transform(lines_of("text"), key_of)).alias("at", "key")).where(F.char_length("key") >= max(min_chars, 1))
    k1, k2 = _hash("key")
    line = line.select("h1", "h2", "at", k1.alias("k1"), k2.alias("k2"))
    n_keys, n_lines = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_keys <= BROADCAST_KEYS:
        found = line.join(F.broadcast(frequent.select("k1", "k2")), ["k1", "k2"])
    else:
        hot = F.col("n") > max(n_lines // HOT_KEYS, 1)  # at most HOT_KEYS keys
        few = F.broadcast(frequent.where(hot).select("k1", "k2", F.lit(True).alias("hot")))
        known = line.join(few, ["k1", "k2"], "left").withColumn("cold", F.col("hot").isNull())
        # A line found already goes anywhere: it has a key that no row of the other side has.
        spread = known.withColumn("k1", F.when(F.col("cold"), F.col("k1")).otherwise(F.xxhash64("h1", "h2", "at", "k1")))
        others = frequent.where(~hot).select("k1", "k2", F.lit(True).alias("cold"), F.lit(True).alias("found"))
        found = spread.join(others, ["k1", "k2", "cold"], "left").where("not cold or found")
    places = found.groupBy("h1", "h2").agg(F.collect_set("at").alias("drop"), F.count("*").alias("lines"))
    return places.select("h1", "h2", "drop", F.expr("lines div size(drop)").alias("rows"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines whose key at least ``min_docs`` documents have, with ``n_lines`` (before) and ``n_dropped``.

    Every occurrence of such a line goes, in every document. The other lines
    stay as they are, joined by line feeds; a text that loses all its lines is
    empty. A null text stays null and counts as one empty line; empty and blank
    lines are no keys. Each row is a document, also where ids repeat or are null.
    An empty table gives no rows. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced, and those of the internal names ``__*`` below.
    """
    names = ["__h1", "__h2", "__lines", "__drop"]
    docs = docs.drop("n_lines", "n_dropped", *names)
    frequent = written(frequent_lines(docs.select("text"), min_docs, min_chars), "frequent")
    drops = written(dropped_lines(docs.select("text"), frequent, min_chars), "drops").withColumnsRenamed({"h1": "__h1", "h2": "__h2", "drop": "__drop"})
    total = drops.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = (F.col("rows") > max(total // HOT_KEYS, 1)) & (F.size("__drop") <= MOST_DROPS)
    by = names[:2]
    h1, h2 = _hash("text")
    # Lines are split below the join, so that the lambda below reads them as a column.
    rows = docs.select("*", h1.alias(by[0]), h2.alias(by[1]), lines_of("text").alias("__lines"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    few = F.broadcast(drops.where(hot).drop("rows"))  # HOT_KEYS texts at most, of MOST_DROPS positions: 16 MB
    joined = rows.join(few, by, "left").where(F.col("__drop").isNotNull() | blank)
    # A text that isn't blank is its lines; it needn't be shuffled beside them.
    rest = rows.where(~blank).drop("text").join(few.select(*by), by, "left_anti").join(drops.where(~hot).drop("rows").hint("shuffle_hash"), by, "left")
    n = F.size("__lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    whole = F.array_join("__lines", "\n")
    kept_text = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")

    def finish(part: DataFrame, unchanged: Column) -> DataFrame:
        text = F.when(F.col("__drop").isNull(), unchanged).otherwise(kept_text).alias("text")
        kept = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
        return part.select(*kept, n.cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))

    return finish(joined, F.col("text")).union(finish(rest, whole))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_sha256``, of the text that ``drop_lines`` leaves."""
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT n, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM numbered
), keyed AS (
  SELECT n, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM line
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT n) >= {MIN_DOCS}
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key)
), kept AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY n
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM numbered JOIN kept USING (n)
"""
