import hashlib
import math

from pyspark.sql import functions as F

from tiermeter.llm import mixing


def plain(rows, weights=None, epochs=1.0):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode())
    w = {s: (b**mixing.FLATTEN if weights is None else weights.get(s, 0.0)) for s, b in size.items()}
    total, mass = sum(size.values()), sum(w.values())
    out = []
    for d, _, s in rows:
        rate = w[s] / mass * epochs * total / size[s] if size[s] and mass else epochs
        assert rate <= mixing.MAX_RATE  # one draw
        u = int(hashlib.sha256(f"{mixing.SEED}|{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        n = 0
        while c <= u and n < 2000:
            n += 1
            p *= rate / n
            c += p
        out += [(-1 if d is None else d, k) for k in range(n)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "clash") for d, t, s in rows], "doc_id long, text string, source string, rate string")


ROWS = [(k, "x" * (k % 40), f"s{k % 3 if k % 5 else 9}") for k in range(600)] + [(1000, None, None), (1001, "", None), (None, "y" * 50, "s1"), (7, "again", "s2"), (7, "again", "s2")]


def test_draws_are_those_of_plain_code(spark):
    for weights, epochs in ((None, 1.0), ({"s0": 1, "s9": 3}, 2.5), (None, 30.0)):
        got = mixing.replicate(frame(spark, ROWS), weights, epochs).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.replica) for r in got) == plain(ROWS, weights, epochs)


def test_shares_come_near_their_targets(spark):
    rows = [(k, "z" * 100, "big" if k % 10 else "small") for k in range(20000)]
    got = mixing.replicate(frame(spark, rows), {"big": 1, "small": 1}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["big"] - 10000) < 300 and abs(n["small"] - 10000) < 600


def test_rates_above_that_of_one_draw_keep_their_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 700)
    rows = [(0, "t" * 10, "tiny"), (1, "t" * 10, "tiny")] + [(k, "z" * 100, "big") for k in range(2, 1002)]
    got = mixing.replicate(frame(spark, rows), {"tiny": 1, "big": 1}).where("source = 'tiny'").collect()
    rate = 0.5 * 100020 / 20
    for d in (0, 1):
        n = sorted(r.replica for r in got if r.doc_id == d)
        want = 0
        for j in range(6):
            u = int(hashlib.sha256(f"{mixing.SEED}{f'.{j}' if j else ''}|{d}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / 6)
            k = 0
            while c <= u:
                k += 1
                p *= rate / 6 / k
                c += p
            want += k
        assert n == list(range(want)) and abs(want - rate) < 5 * rate**0.5
    assert {r.rate for r in got} == {rate}


def test_many_sources_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    got = mixing.replicate(frame(spark, ROWS)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.replica) for r in got) == plain(ROWS)


def test_a_single_huge_source(spark):
    rows = [(k, "x" * 30, "one") for k in range(3000)]
    got = mixing.replicate(frame(spark, rows), epochs=2.0).collect()
    assert sorted((r.doc_id, r.replica) for r in got) == plain(rows, None, 2.0)


def test_oracle_has_no_cap(spark, tmp_path):
    import duckdb
    import pandas as pd

    pd.DataFrame({"doc_id": [0, 1, 2], "text": ["t", "z" * 1_000_000, "z" * 1_000_000], "lang": "en", "source": ["tiny", "big", "big"], "n_chars": [1, 1, 1]}).to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet')")
    want = sorted(con.execute(f"SELECT source, count(*), max(rate) FROM ({mixing.ORACLE}) GROUP BY source").fetchall())
    got = sorted((r.source, r.n, r.rate) for r in mixing.replicate(spark.read.parquet(f"{tmp_path}/d.parquet")).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and got[-1][2] > mixing.MAX_RATE


def test_order_and_plan(spark):
    out = mixing.replicate(frame(spark, ROWS))
    again = mixing.replicate(frame(spark, ROWS))
    assert [r.shuffle_key for r in out.collect()] == [r.shuffle_key for r in again.collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert mixing.replicate(frame(spark, [])).count() == 0


def test_oracle(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    want = sorted(con.execute(f"SELECT doc_id, replica, shuffle_key FROM ({mixing.ORACLE})").fetchall())
    got = sorted((r.doc_id, r.replica, r.shuffle_key) for r in mixing.replicate(spark.read.parquet(path)).collect())
    assert got == want
