"""How far the sources of a language differ in their words (op 11).

Terms are counted in Arrow batches, one table for each (lang, source, term) with
occurrences and documents, summed map-side and then by Spark. A language keeps
the terms of at least ``MIN_DOCS`` of its documents. Its kept terms are dealt to
blocks by hash, and its sources to blocks of ``GROUP_BLOCK``; a unit is a block of
terms with two blocks of sources. In a unit the counts become a dense int64
tile of sources by terms, from which all pairs of sources are taken at once by
broadcasting, and each source's largest excesses over its language by a heap.
What leaves a unit is a partial matrix of pairs and at most ``TOP`` terms of each
source; partial matrices are summed by Spark and the heaps merged.

Nothing needs a group whole: a unit has at most ``2 * GROUP_BLOCK`` sources by
about ``TERM_BLOCK`` terms, whatever the size of a language or a source.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, sliced, tidied, written
from tiermeter.llm.graph import hot_join

MIN_DOCS, TOP = 30, 50
#: p is 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V)).
UNIT, SMOOTH = 1_000_000_000, 5
#: Terms and sources of a unit's blocks.
TERM_BLOCK, GROUP_BLOCK = 1024, 256
#: Counted terms that a task holds before it gives them on.
HELD_TERMS = 1 << 18
#: Cells of one broadcast of pairs.
CELLS = 1 << 20

#: A-Z to lower case, the other ASCII characters but a-z to spaces; what is left between spaces is a term.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and ``docs`` with the term; null texts, langs and sources are ''.

    A (lang, source) without terms has one row with a null term.
    """
    target = arrow_schema(COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs: dict[tuple[str, str], Counter] = {}
        within: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counted in occurs.items():
                terms = [None, *counted]
                texts = pa.array(terms, pa.binary()).cast(pa.string())
                n, docs = [0, *counted.values()], [0, *map(within[lang, source].__getitem__, counted)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), texts, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=target)
            occurs.clear()
            within.clear()

        for columns in sliced(batches):
            for lang, source, text in zip(columns["lang"], columns["source"], columns["text"], strict=True):
                words = text.translate(_TERM_BYTES).split()
                at = (lang, source)
                if at not in occurs:
                    occurs[at], within[at] = Counter(), Counter()
                occurs[at].update(words)
                within[at].update(set(words))
            if sum(map(len, occurs.values())) > HELD_TERMS:
                yield from flush()
        yield from flush()

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text)
    counted = rows.mapInArrow(tidied(run), COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * n_terms)), exactly, for totals below 2^53.

    UNIT is multiplied in by thousands, as in long division, so that no product leaves 64 bits.
    """
    below = total + SMOOTH * n_terms
    left, out = count + SMOOTH, np.ones_like(count)
    whole = np.zeros_like(count)
    for _ in range(3):  # UNIT is 1000 to the third
        left = left * 1000
        step = left // below
        whole, left = whole * 1000 + step, left - step * below
    return out + whole


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of |a[i] - b[j]| over the columns, for all rows i and j, by broadcasting slices."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    step = max(1, CELLS // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(axis=2)
    return out


PARTIAL = "lang string, source string, part string, item string, value long"


def _unit(table: pa.Table, top: int) -> pa.Table:
    """One unit: partial pair sums, and each source's terms of largest excess.

    Rows without a term name the unit's sources: ``n`` is the lang's V, ``total`` the source's N, ``of_lang`` the
    lang's N, ``size`` the terms of the block. The others have a source's count ``n`` of a term, and the lang's.
    """
    table = table.combine_chunks()
    empty = pc.is_null(table["term"])
    marks, cells = table.filter(empty), table.filter(pc.invert(empty))
    lang, ga, gb = (table[c][0].as_py() for c in ("lang", "ga", "gb"))
    names = marks["source"].to_pylist()
    n_terms, lang_total, size = (marks[c][0].as_py() for c in ("n", "of_lang", "size"))
    coded = pc.dictionary_encode(cells["term"].combine_chunks())
    k, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    tile = np.zeros((len(names), len(words)), dtype=np.int64)
    tile[pc.index_in(cells["source"], value_set=marks["source"].combine_chunks()).to_numpy(), k] = cells["n"].to_numpy()
    of_lang = np.zeros(len(words), dtype=np.int64)
    of_lang[k] = cells["of_lang"].to_numpy()
    totals = marks["total"].to_numpy()[:, None]
    p, absent = tile, np.zeros_like(totals)
    if n_terms:
        p, absent = shares(tile, totals, n_terms), shares(np.zeros_like(totals), totals, n_terms)
    block = marks["g"].to_numpy()
    first, second = np.flatnonzero(block == ga), np.flatnonzero(block == gb)
    # Terms of the block that none of these sources has count too.
    sums = pair_sums(p[first], p[second]) + (size - len(words)) * pair_sums(absent[first], absent[second])
    out = [(names[a], "pair", names[b], int(sums[i, j])) for i, a in enumerate(first) for j, b in enumerate(second) if a != b]
    if ga != gb:
        out += [(b, part, a, f) for a, part, b, f in out]
    elif words:
        over = np.where(tile > 0, p - shares(of_lang, np.int64(lang_total), n_terms)[None, :], 0)
        for i, s in enumerate(names):
            best = heapq.nsmallest(top, ((-int(over[i, t]), words[t].encode(), t) for t in np.flatnonzero(over[i] > 0)))
            out += [(s, "term", words[t], -f) for f, _, t in best]
    target = arrow_schema(PARTIAL)
    columns = zip(*((lang, *r) for r in out), strict=True) if out else ((),) * len(target)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every (lang, source) that occurs.

    Part ``pair`` has each other source of the lang, with the sum of the
    differences over all kept terms (0 if the lang keeps none); part ``term``
    the source's terms above their share in the lang, up to rank ``top``.
    Ranks go by value downwards, then by the item's UTF-8 bytes. Null texts,
    langs and sources are ''; repeated rows count as often as they are there. An
    empty table gives no rows, a source alone in its lang no pairs.
    """
    counts = written(count_terms(docs), "counts")
    terms = counts.where("term is not null")
    kept = written(terms.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= min_docs).drop("in_docs"), "kept")
    known = written(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "known")
    langs = written(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_n")), "langs")
    n_kept = langs.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    of_source = known.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    all_sources = counts.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(langs, "lang", "left")
    in_lang = Window.partitionBy("lang")
    g = F.floor((F.row_number().over(in_lang.orderBy("source")) - 1) / GROUP_BLOCK).cast("int").alias("g")
    groups = all_sources.select("lang", "source", zero("total"), zero("rows"), zero("v"), zero("lang_n"), g)
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / TERM_BLOCK)).cast("int")).withColumn("last_g", F.max("g").over(in_lang))
    groups = written(groups, "groups")
    n_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # Sources with many terms are broadcast to their counts.
    placed = hot_join(known, groups.select("lang", "source", "rows", "g", "blocks", "last_g"), ["lang", "source"], "rows", n_rows, "inner")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sizes = hot_join(kept.select("lang", "term"), langs.select("lang", "v", F.ceil(F.col("v") / TERM_BLOCK).cast("int").alias("blocks")), "lang", "v", n_kept, "inner").groupBy("lang", block).agg(F.count("*").alias("size"))
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    none = F.lit(None).cast("string").alias("term")
    columns = ["lang", "block", "source", "g", "last_g", "term", "n", "total", "of_lang", "size"]
    marks = marks.select("lang", "block", "source", "g", "last_g", none, F.col("v").alias("n"), "total", F.col("lang_n").alias("of_lang"), zero("size"))
    cells = placed.select("lang", block, "source", "g", "last_g", "term", "n", F.lit(0).cast("long").alias("total"), "of_lang", F.lit(0).cast("long").alias("size"))
    units = marks.union(cells.select(*columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last_g"))))
    units = units.select(*columns, F.least("g", "other").alias("ga"), F.greatest("g", "other").alias("gb"))
    partial = written(units.groupBy("lang", "block", "ga", "gb").applyInArrow(lambda table: _unit(table, top), PARTIAL), "partial")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    best = partial.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.union(best)


ORACLE = f"""
WITH doc AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), word AS (
  SELECT n, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{ascii_uppercase}', '{ascii_lowercase}') AS term FROM doc
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n_lang FROM word GROUP BY lang, term HAVING count(DISTINCT n) >= {MIN_DOCS}
), lang AS MATERIALIZED (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n_lang), 0) AS total FROM (SELECT DISTINCT lang FROM doc) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
), counted AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL
), grp AS MATERIALIZED (
  SELECT d.lang, d.source, coalesce(c.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM doc) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) c USING (lang, source)
), cell AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * l.v) AS BIGINT) AS p,
    CAST(1 + ({UNIT}::HUGEINT * (k.n_lang + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS BIGINT) AS q
  FROM grp g JOIN lang l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM cell WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM listed
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
