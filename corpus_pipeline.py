"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each stage's result as Parquet in
the shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiermeter.llm import mixing, ngram_join, packing, pii, quality
from tiermeter.llm.common import MADE, documents, drop_tables, tune, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, scores 0.7 or more."""
    tune(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest id of each group of documents linked by five-word Jaccard similarity of 0.8 or more."""
    tune(spark)
    return ngram_join.one_of_each(docs)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows a changed text."""
    tune(spark)
    return pii.rewrite(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their Poisson draw at their source's rate says, globally shuffled."""
    tune(spark)
    return mixing.replicate(docs).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several context sizes."""
    tune(spark)
    return packing.digests(packing.pack(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", with_surrogates),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: SQL can't express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage made go when its result is written."""
    docs = documents(spark, sf_dir)
    before = len(MADE)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
            drop_tables(spark, before, keep=1)
    return docs
