import hashlib
import string
from collections import Counter

import pytest

from tiermeter.llm import line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(texts, min_docs=10, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= max(min_chars, 1))
    kept = [[x for x in ls if not (len(key(x)) >= max(min_chars, 1) and seen[key(x)] >= min_docs)] for ls in lines]
    return [(len(ls), len(ls) - len(ks), "\n".join(ks)) for ls, ks in zip(lines, kept, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 1) for i, t in rows], "doc_id long, text string, n_lines string, n_dropped int, __drop int")


SHARED = "  All rights RESERVED. \r"
TEXTS = (
    [f"line {k}\n{SHARED if k % 2 else 'all rights reserved.'}\nown {k}\n{SHARED}" for k in range(9)]
    + ["ALL rights reserved."]  # the tenth document
    + [f"nine of these\n\n{k}\n\n" for k in range(9)]
    + ["same text\nin copies"] * 12
    + ["ÄRGER İ\nx"] * 9 + ["ärger İ"] * 3  # only A-Z are lowered
    + [None, "", "\n", " \t ", "\n\n\n", "\x0b\x0c\r", "x ", " "]
    + ["b" * 40_000 + "\n" + "\n".join(f"w{j % 50}" for j in range(20_000))] * 11
)


@pytest.mark.parametrize(("broadcast", "min_docs", "min_chars"), [(line_dedup.BROADCAST_KEYS, 10, 1), (0, 10, 1), (0, 2, 1), (line_dedup.BROADCAST_KEYS, 10, 6)])
def test_same_as_plain_code(spark, monkeypatch, broadcast, min_docs, min_chars):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    rows = [(None if k % 17 == 3 else k // 2, t) for k, t in enumerate(TEXTS)]
    got = line_dedup.drop_lines(frame(spark, rows), min_docs, min_chars).collect()
    want = [(-1 if i is None else i, *w) for (i, _), w in zip(rows, plain(TEXTS, min_docs, min_chars), strict=True)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == sorted(want)
    assert sum(r.text is None for r in got) == 1


@pytest.mark.parametrize("most", [line_dedup.MOST_DROPS, 1])
def test_hot_keys_and_texts_are_joined_apart(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "MOST_DROPS", most)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 4)
    texts = [f"hot\nline {k % 30}\nown {k}" for k in range(400)] + ["hot\nhot"] * 200
    got = line_dedup.drop_lines(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == plain(texts)


def test_digests_of_few_and_no_rows(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = line_dedup.digests(frame(spark, [(1, None), (2, "a\nA")])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, sha("")), (2, 2, 0, sha("a\nA"))]
    assert line_dedup.digests(frame(spark, [])).collect() == []


def test_other_columns_stay(spark):
    out = line_dedup.drop_lines(frame(spark, [(k, "x\ny") for k in range(10)]).withColumnsRenamed({"n_lines": "odd.name"}))
    assert out.columns == ["doc_id", "text", "odd.name", "n_lines", "n_dropped"]
    assert {(r.text, r["odd.name"], r.n_dropped) for r in out.collect()} == {("", "clash", 2)}
