import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_dedup import brute, shingles  # noqa: F401
from test_mixing import plain as drawn
from test_tokens import library
from tiermeter.llm import pii, quality

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_code(spark):
    """The whole pipeline, stage by stage, each held against code without Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = docs.columns
    out = stages["quality classifier"](spark, docs, SF)
    assert out.columns == names
    kept = {r.doc_id: r.text for r in out.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in docs.collect() if model.score([r.text.encode()])[0] >= 0.7}

    rows = sorted(kept.items())
    out = stages["n-gram Jaccard join"](spark, out, SF)
    left = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == names and set(left) == {d for d, c, _ in brute(rows) if d == c}

    out = stages["PII"](spark, out, SF)
    new = {r.doc_id: r for r in out.collect()}
    assert out.columns == names and set(new) == set(left)
    for d, text in left.items():
        assert new[d].text == pii.replaced(text)[0] and new[d].n_chars == len(new[d].text)

    triples = [(r.doc_id, r.text, r.source) for r in new.values()]
    out = stages["mixing sources to target weights"](spark, out, SF)
    copies = Counter(r.doc_id for r in out.collect())
    assert out.columns == names and copies == Counter(d for d, _ in drawn(triples))

    rows = stages["packing"](spark, out, SF).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == Counter({d: n * (len(library(new[d].text)) + 1) for d, n in copies.items()})
    for r in rows[:200]:
        ids = np.array([*library(new[r.doc_id].text), 1], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_run_gives_the_same(spark):
    first = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(first.columns)
    key = lambda df: sorted((r.doc_id, r.start, r.length) for r in df.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    tokens = lambda k: Counter({d: sum(n for x, _, n in k if x == d) for d in {x for x, *_ in k}})
    assert tokens(key(first)) == tokens(key(docs))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "text", "en", None, 4), (None, None, None, "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 4000, None, None, 20000)]])
def test_odd_tables_pass_through(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string, shuffle_key int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality classifier":
            continue
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() == 0 or rows
