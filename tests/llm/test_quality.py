import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tiermeter.llm import labelled, quality, rules
from tiermeter.llm.common import documents

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_rules(text):
    words = words_of(text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def texts(seed=0):
    rng = random.Random(seed)
    pieces = ["a", "bb", "é日", "#*", "x|y", "\n", "\n\n", " \n ", "\t", "a bb a bb a", "line\nline\n", "\xa0"]
    return ["", " ", "\n", "a", "a a a", "a a a a", "x\n x\nx\n\n"] + [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("size", [1, 7, 500])
def test_base_rules_are_those_of_plain_code(size):
    every = texts()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i in range(0, len(every), size):
        got = rules.base_rules([t.encode() for t in every[i : i + size]])
        for k, t in enumerate(every[i : i + size]):
            assert tuple(int(got[n][k]) for n in names) == plain_rules(t), t


def test_statistics_do_not_depend_on_the_batch():
    every = [t.encode() for t in texts(1)]
    together = quality.statistics(every)
    alone = np.vstack([quality.statistics([t]) for t in every])
    assert np.allclose(together, alone) and np.isfinite(together).all() and (together <= 2).all()


def test_logits_are_sums_over_counted_features():
    every = [t.encode() for t in texts(2)]
    w = np.random.default_rng(0).normal(size=1 << rules.BITS).astype(np.float32)
    want = np.full(len(every), 0.25)
    for feature, text, value in rules.counted(every):
        want += np.bincount(text, weights=w[feature] * value, minlength=len(every))
    assert np.allclose(rules.logits(every, w, 0.25), want, atol=1e-4)


def test_isotonic_is_the_max_min_of_means():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.integers(0, 12, 40).astype(float)
        y = (rng.random(40) < x / 12).astype(int)
        xs, ys = quality.isotonic(x, y)
        values = np.unique(x)
        s, n = np.array([y[x == v].sum() for v in values]), np.array([(x == v).sum() for v in values])
        want = [max(min(s[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(values))) for j in range(i + 1)) for i in range(len(values))]
        assert np.allclose(np.interp(values, xs, ys), want)


def test_platt_follows_the_labels():
    z = np.linspace(-4, 4, 400)
    y = (np.random.default_rng(0).random(400) < 1 / (1 + np.exp(-(2 * z + 1)))).astype(int)
    a, b = rules.platt(z, y)
    assert 1.3 < a < 3 and 0.3 < b < 2
    assert rules.platt(z, np.ones(400, dtype=int)) == (1.0, 0.0)


def test_folds_and_sample(spark):
    d = spark.createDataFrame([(k, f"text {k}", 1) for k in range(400)] + [(None, "x", 1)], "doc_id long, text string, label int")
    l = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, text int")
    rows = labelled.sample(d, l, "quality", 100).collect()
    assert len(rows) == 100 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
    assert {r.label for r in rows if r.doc_id == 3} <= {0}
    assert labelled.sample(d, l, "quality", 1000).count() == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(400))


def held_out_accuracy(spark, rows, column):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    return np.mean([r[column] == truth[r.doc_id] for r in rows if r.doc_id in truth])


def test_quality_scores_hold_out(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held_out_accuracy(spark, rows, "predicted") > 0.93


def test_rules_hold_out(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    rows = rules.judge(docs, rules.fit(docs, labels)).collect()
    assert all(not (r.base_failed and r.kept) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    judged = [(r.probability >= 0.5, truth[r.doc_id]) for r in rows if r.doc_id in truth and not r.base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.9


ODD = [(1, None), (2, ""), (3, "word " * 30000), (None, "some text"), (4, "same"), (4, "same"), (5, " \n")]


def test_odd_rows_and_missing_labels(spark):
    d = spark.createDataFrame([(i, t, 0.5, True) for i, t in ODD], "doc_id long, text string, score double, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(d, none)
    rows = quality.score(d, model).collect()
    assert len(rows) == len(ODD) and {round(r.score, 6) for r in rows} == {0.5}
    assert quality.keep_good(d, model, 0.5).schema == d.schema and quality.keep_good(d, model, 0.5).count() == len(ODD)
    assert quality.keep_good(d, model, 0.6).count() == 0
    judge = rules.judge(d, rules.fit(d, none)).collect()
    assert len(judge) == len(ODD) and {r.probability for r in judge} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(1, 6)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.score(d, quality.fit(d, one)).collect())
    assert quality.score(d.limit(0), model).count() == 0 and rules.judge(d.limit(0), rules.fit(d.limit(0), none)).count() == 0


def test_repeated_labelled_rows_keep_to_the_bound(spark):
    from tiermeter.llm.labelled import sample

    docs = spark.createDataFrame([(k % 7, f"text {k % 3}") for k in range(300)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)] * 3 + [(None, 1)], "doc_id long, quality int")
    rows = sample(docs, labels, "quality", 100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 7
    again = sample(docs.repartition(5), labels, "quality", 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
