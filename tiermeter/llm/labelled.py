"""Labelled rows for fitting: folds, and bounded samples with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import with_bytes


def fold(doc_id: str | Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: str, folds: int, held: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 4, held: int = 2) -> DataFrame:
    """At most ``bound`` labelled documents outside the held-out fold: doc_id, text (bytes), label.

    The rows are those with the lowest hashes of their ids, so the sample is the
    same at any partitioning. Only their ids (at most ``bound``) are broadcast;
    only their documents are shuffled. Of rows that repeat an id the text of lowest
    hash counts, so the bound holds for rows too. An id with contradicting labels
    counts with the lower one; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = known.where(~held_out("doc_id", folds, held)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = with_bytes(docs, "doc_id").join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return one.select("doc_id", F.col("first.text").alias("text"), "label")
