import re

import pytest

import __spark_entry__
from tiermeter.llm import queries


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_\w+$", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["op9_mixing", "op13_line_dedup"])
def test_native_query_has_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
