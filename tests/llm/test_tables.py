import os

import pytest

import corpus_pipeline
from tiermeter.llm import common


def test_tables_of_a_stage_go(spark):
    a, b, c = (common.written(spark.range(3), n) for n in "abc")
    mark = len(common.MADE) - 2
    paths = [p.removeprefix("file://") for p in common.MADE[-3:]]
    common.drop_tables(spark, mark, keep=1)
    assert [os.path.exists(p) for p in paths] == [True, False, True] and a.count() == c.count() == 3


def test_the_pipeline_leaves_one_table_of_documents(spark):
    before = len(common.MADE)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert rows and sum("stage" in p for p in common.MADE[before:]) == 1


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://head:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
