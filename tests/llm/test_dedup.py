import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermeter.llm import graph, ngram_join


def shingles(text, size=5):
    words = [w for w in (text or "").translate(str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i][0] is None or rows[j][0] is None or not sets[i]:
                continue
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    lowest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        lowest[root(i)].append(d)
    return sorted(((d if d is not None else -1), -1 if d is None else min(x for x in lowest[root(i)] if x is not None), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed=0, base=25, copies=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(base):
        words = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
        rows.append(" ".join(words))
        rows.append(" ".join(words).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")


def result(spark, rows, **options):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in ngram_join.similar(frame(spark, rows), **options).collect())


def test_links_and_classes_are_those_of_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "three little words"), (None, "two words")]
    assert result(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = corpus(1, base=3, copies=40)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    assert result(spark, rows) == brute(rows)


def test_buckets_give_the_same(spark, monkeypatch):
    """Components whose buckets hold fewer pairs are verified by bucket, with each pair counted once."""
    rows = corpus(2, base=4, copies=30)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(ngram_join, "_units", lambda candidates, members: members.select(F.col("bucket").alias("unit"), "band", "node"))
    assert result(spark, rows) == brute(rows)


def test_a_chain_is_verified_by_its_buckets(spark, monkeypatch):
    """A long chain of texts, each like the next alone, has few pairs in its buckets."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 64)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(1500)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(340)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_one_of_each_keeps_columns_and_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (5, "q w e r t y u"), (5, "q w e r t y u"), (None, "a b c d e f g"), (7, None), (8, "")]
    got = ngram_join.one_of_each(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "class_id"]
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect()) == [-1, 1, 5, 7, 8]


def test_repeated_ids_of_different_texts_lose_nothing(spark):
    a, b, c = "a b c d e f g", "q w e r t y u", "z x c v b n m"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, "Z  x c v b n m"), (4, None), (4, ""), (4, a), (5, c)]
    got = sorted((r.doc_id, r.text or "") for r in ngram_join.one_of_each(frame(spark, rows)).collect())
    assert [(d, t) for d, t in got if d < 3] == [(1, a), (2, b)]
    assert len([t for d, t in got if d == 3]) == 1 and [t for d, t in got if d == 4] == ["", ""] and len(got) == 5
    assert result(spark, rows) == brute(rows)


def test_band_choice_reaches_its_recall():
    bands, rows = ngram_join.bands_and_rows(0.8, 0.9995)
    assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9995


@pytest.mark.parametrize("threshold", [0.03, 0.06, 0.2, 0.5, 0.95, 1.0])
def test_any_threshold_reaches_its_recall(threshold):
    bands, rows = ngram_join.bands_and_rows(threshold, 0.9995)
    assert 1 - (1 - threshold**rows) ** bands >= 0.9995


def test_linked_across_two_lists():
    a = [np.array([1, 2, 3, 4], dtype=np.uint64), np.array([9, 10], dtype=np.uint64)]
    b = [np.array([1, 2, 3, 4, 5], dtype=np.uint64), np.array([9, 11], dtype=np.uint64)]
    assert ngram_join.linked(a, b, 0.8).tolist() == [[True, False], [False, False]]
    assert not ngram_join.linked(a, None, 0.8).any()


@pytest.mark.parametrize("in_one_task", [1 << 20, 0])
def test_components_of_a_path_and_a_star(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(graph, "TASK_EDGES", in_one_task)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[k] for k in range(1000, 1100)} == {1000}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_roots_of_random_graphs():
    rng = np.random.default_rng(0)
    for n in (1, 5, 50, 400):
        for _ in range(20):
            u, v = rng.integers(0, n, n), rng.integers(0, n, n)
            parent = list(range(n))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            node, got = graph.roots(u, v)
            assert [root(x) for x in node.tolist()] == got.tolist()
