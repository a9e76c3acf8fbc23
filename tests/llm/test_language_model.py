import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermeter.llm import language_model as lm
from tiermeter.llm.common import with_bytes
from tiermeter.llm.kernels import Batch


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def check(rows, given):
    count = Counter(w for d, t in given if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in given)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")


ROWS = [(k, f"The cat {'sat on' if k % 2 else 'ran to'} the mat{k % 50}. É end") for k in range(300)] + [(900, None), (901, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (902, "long word " * 20000)]


def test_counts_and_base_scores(spark):
    check(lm.language_model(frame(spark, ROWS)).collect(), ROWS)


def test_rare_words_come_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "TOP_WORDS", 3)
    few = lm.language_model(frame(spark, ROWS)).collect()
    check(few, ROWS)
    monkeypatch.setattr(lm, "TOP_WORDS", 1 << 19)
    many = lm.language_model(frame(spark, ROWS)).collect()
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.score)
    assert np.allclose([r.score for r in sorted(few, key=key)], [r.score for r in sorted(many, key=key)], rtol=1e-6)


def test_it_beats_the_base_on_held_out_texts(spark):
    rows = lm.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    out = [r for r in rows if not r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_learn_from(spark):
    assert lm.language_model(frame(spark, [])).count() == 0
    only = [(d, "some text") for d in range(200) if held(d)]
    rows = lm.language_model(frame(spark, only)).collect()
    assert len(rows) == len(only) and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in rows)


def test_softmaxes_add_up():
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(500, lm.CLASSES)).astype(np.float32), rng.normal(size=lm.CLASSES).astype(np.float32)
    rows = [rng.integers(0, 500, 50) for _ in range(3)]
    at = lambda bias, k: np.exp(lm.log_softmax_at(w, bias, rows, np.full(50, k)))
    assert np.allclose(sum(at(b, k) for k in range(lm.CLASSES)), 1, atol=1e-5)
    of_each = np.repeat(b[None, :], 50, axis=0)
    of_each[:, 3] = -np.inf
    assert np.allclose(sum(at(of_each, k) for k in range(lm.CLASSES)), 1, atol=1e-5) and (at(of_each, 3) == 0).all()


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 40, 5000), 40 + rng.integers(0, 40, 5000)]
    goal = (rows[0] + rows[1]) % 7
    w, grown, b = np.zeros((80, 7), np.float32), np.full((80, 7), 1e-7, np.float32), np.zeros(7, np.float32)
    losses = []
    for _ in range(30):
        losses.append(-lm.log_softmax_at(w, b, rows, goal).mean())
        lm.gradient_step(w, grown, b, rows, goal)
    assert losses[-1] < losses[0]


def parts_of(text, m):
    """(hash, form, unit) of each word and the end, one by one."""
    out = []
    for w in tokens(text)[:-1]:
        b = Batch([w.encode()], lower=True)
        h, f = int(b.words()[0]), int(lm.forms(b)[0])
        at = np.flatnonzero(m.frequent == np.uint64(h))
        out.append((h, f, lm.FORMS + int(at[0]) if len(at) else f, int(m.place[at[0]]) if len(at) else 0))
    return [*out, (int(lm.END_WORD), lm.EDGE, lm.EDGE, 0)]


def probability(m, count, context, word):
    """P(word | the last three units), by the model's formula written out."""
    one, two, three = context
    n = lm.FORMS + len(m.frequent)
    h, form, _, place = word
    if h not in count:
        return m.unseen
    a, b = np.array([one]), np.array([two])
    z = m.bias + sum(m.weights[r].astype(float) for r in (one, n + two, 2 * n + three, 3 * n + int(lm.pair_row(m.pairs, a, b)[0])))
    c = m.class_of[form]
    p = np.exp(z - z.max())
    p = p[c] / p.sum()
    z = m.place_bias[c] + sum(m.place_weights[int(r[0])].astype(float) for r in lm.place_rows(np.array([c]), a, b))
    q = np.exp(z - z.max())
    p *= q[place] / q.sum()
    return p * (1 - m.unseen) * (1 if place else (count[h] + lm.SMOOTH) / m.rest_mass[c])


def test_scores_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}{'abc'[k % 3]}" for k in range(60)]
    rows = [(k, " ".join(vocabulary[int(x)] for x in rng.zipf(1.3, 30) % 60)) for k in range(120)] + [(500, None), (501, "new words here"), (None, "w1b w1b")]
    given = with_bytes(frame(spark, rows), "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = [(d, t) for d, t in rows if not held(d)]
    m, table = lm.fit(given.where(~lm.held_out("doc_id", 10, 0)))
    assert len(m.frequent) > 10 and m.place.max() > 2
    count = {int(np.int64(r.word).view(np.uint64)): r.n for r in table.collect()}
    assert sum(count.values()) == sum(len(tokens(t)) for _, t in train)
    got = {(-1 if r.doc_id is None else r.doc_id): r.score for r in lm.score(given, m, table).collect()}
    for d, t in rows:
        line = parts_of(t, m)
        units = [lm.EDGE] * 3 + [x[2] for x in line]
        want = sum(math.log10(probability(m, count, (units[k + 2], units[k + 1], units[k]), x)) for k, x in enumerate(line))
        assert got[-1 if d is None else d] == pytest.approx(want, rel=1e-4), d
    # over all words and the unseen one, any context has a mass of one at most
    words = {}
    for _, t in train:
        words |= {x[0]: x for x in parts_of(t, m)}
    for context in ((lm.EDGE, lm.EDGE, lm.EDGE), (5, 7, 9), (lm.FORMS, lm.FORMS + 1, 3)):
        mass = sum(probability(m, count, context, x) for x in words.values()) + m.unseen
        assert 0.9 < mass <= 1 + 1e-4


def test_ties_and_the_edge_of_the_broadcast(spark):
    words = spark.createDataFrame([(k, 1 + k // 10) for k in range(100)] + [(1000 + k, 1) for k in range(500)], "word long, n long")
    for most in (0, 1, 9, 10, 35, 100, 599, 600, 10_000):
        least = lm.least_count(words, most)
        assert words.where(words.n >= least).count() <= most
    assert lm.least_count(words, 10_000) == 1 and lm.least_count(words.limit(0), 5) == 1


def test_words_without_a_place_follow_what_stands_before(spark):
    """Words beyond a class's places differ by context: the one that follows there in training is likelier."""
    rows = [(k, " ".join(f"y{j % 200:03d}lor x{j % 200:03d}qua" for j in range(k, k + 40))) for k in range(400)]
    out = [d for d in range(1000, 3000) if held(d)][:80]
    rows += [(d, f"y{k:03d}lor x{(k + (i % 2) * 90) % 200:03d}qua") for i, d in enumerate(out) for k in [i // 2 * 5]]
    score = {r.doc_id: r.score for r in lm.language_model(frame(spark, rows)).collect()}
    better = [score[a] - score[b] for a, b in zip(out[::2], out[1::2], strict=True)]
    assert np.median(better) > 0.5 and sum(x > 0.5 for x in better) > 0.8 * len(better)


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    for name, value in (("PLACES", 3), ("TOP_WORDS", 9), ("DEALT_TOKENS", 300), ("PART_TOKENS", 200)):
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{int(x)}{'abc'[int(x) % 3]}" for x in rng.zipf(1.4, 40) % 90)) for k in range(200)] + [(500, None), (501, "new words here"), (503, ""), (None, "w1b w1b"), (502, "w7b w8c w9a " * 50)]
    given = with_bytes(frame(spark, rows), "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = given.where(~lm.held_out("doc_id", 10, 0))
    m, table = lm.fit(train)
    paired = lm.followers(train, m)
    assert lm.parts_of(m.tokens) > 16
    word = {}

    def line(text):
        """(context, class, word) of each word in a rest, or nothing for it."""
        parts, out, last = parts_of(text, m), [], int(lm.END_WORD)
        for h, f, _, place in parts[:-1]:
            word[h] = m.class_of[f]
            out.append(None if place else (int(lm.contexts(np.array([last], dtype=np.uint64))[0]), int(word[h]), h))
            last = h
        return out

    pairs = Counter(x for d, t in rows if not held(d) for x in line(t) if x)
    n, kinds, count = Counter(), Counter(), Counter()
    for (u, g, w), c in pairs.items():
        n[u, g] += c
        kinds[u, g] += 1
        count[w] += c
    assert max(pairs.values()) > 20 and len(count) > 40

    def share(w):
        return (count[w] + lm.SMOOTH) / m.rest_mass[word[w]]

    def probability_in_rest(u, g, w):
        return (max(pairs[u, g, w] - 1, 0) + kinds[u, g] * share(w)) / n[u, g] if n[u, g] else share(w)

    plain, got = ({(-1 if r.doc_id is None else r.doc_id): r for r in lm.score(given, x, table).collect()} for x in (m, paired))
    assert len(plain) == len(got) == len(rows)
    for d, t in rows:
        a, b = plain[-1 if d is None else d], got[-1 if d is None else d]
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score, abs=1e-9)
        want = sum(math.log10(probability_in_rest(*x) / share(x[2])) for x in line(t) if x and count[x[2]])
        assert b.score - a.score == pytest.approx(want, abs=1e-4 * max(1, len(tokens(t)) / 20)), d
    for u, g in n:
        mass = sum(probability_in_rest(u, g, w) for w in count if word[w] == g)
        assert 0.9 < mass < 1 + 1e-9
