import random

import pytest

from tiermeter.operators import matching


def brute(requests, prompts):
    out = {}
    for i, q in requests:
        for k, p in prompts:
            if p and q and p in q:
                out[i] = max(out.get(i, (0, k)), (len(p), k))
    return sorted((i, k) for i, (_, k) in out.items())


def frames(spark, requests, prompts):
    return spark.createDataFrame(requests, "request_id long, request string, task_id string"), spark.createDataFrame(prompts, "task_id long, prompt string, chars string")


@pytest.mark.parametrize("shard_chars", [matching.SHARD_CHARS, 2000, 60])
def test_prompts_of_all_lengths_in_long_requests(spark, shard_chars):
    r = random.Random(2)
    word = lambda n: "".join(r.choices("abü😀 ", k=n))
    prompts = [(k, word(1 + k % 30)) for k in range(400)] + [(1000, None), (1001, ""), (1002, "ab"), (1003, "ab"), (1004, "zz" * 40)]
    requests = [(k, word(5000 if k % 3 else 40)) for k in range(60)] + [(90, None), (91, ""), (92, "q"), (93, "zz" * 50), (93, "ab"), (94, "a" * 5000)]
    a, b = frames(spark, [(*x, "clash") for x in requests], [(*x, "clash") for x in prompts])
    assert sorted(map(tuple, matching.longest_contained(a, b, shard_chars).collect())) == brute(requests, prompts)


@pytest.mark.parametrize("shard_chars", [matching.SHARD_CHARS, 10])
def test_nothing_to_find(spark, shard_chars):
    a, b = frames(spark, [(1, "text", "x")], [(1, "none of it", "x"), (2, "not this", "x")])
    assert matching.longest_contained(a, b, shard_chars).collect() == []
    assert matching.longest_contained(a, b.limit(0), shard_chars).collect() == [] and matching.longest_contained(a.limit(0), b, shard_chars).collect() == []


def test_rows_are_linear_in_requests(spark, monkeypatch):
    """A request full of matches is one row of each shard, and none meets all prompts."""
    made = []
    whole = matching._through_shards

    def watched(asked, prompts, shards, schema):
        made.append((whole(asked, prompts, shards, schema).count(), shards))
        return whole(asked, prompts, shards, schema)

    monkeypatch.setattr(matching, "_through_shards", watched)
    a, b = frames(spark, [(k, "a" * 3000, "x") for k in range(50)], [(k, "a" * (k + 1), "x") for k in range(40)])
    assert sorted(map(tuple, matching.longest_contained(a, b, 300).collect())) == [(k, 39) for k in range(50)]
    assert made[0][1] == 3 and made[0][0] <= 50 * 3


def test_ids_of_any_type(spark):
    a = spark.createDataFrame([("r", "the cat")], "request_id string, request string")
    b = spark.createDataFrame([("t1", "cat"), ("t2", "cat"), ("t0", "at")], "task_id string, prompt string")
    assert [tuple(r) for r in matching.longest_contained(a, b).collect()] == [("r", "t2")]
