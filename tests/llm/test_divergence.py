import re
import string

import numpy as np
import pytest

from tiermeter.llm import divergence

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=30, top=50):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [([w.translate(LOWER) for w in TERM.findall(t)], s) for t, la, s in rows if la == lang]
        seen, count = {}, {}
        for words, s in docs:
            count.setdefault(s, {})
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
            for w in words:
                count[s][w] = count[s].get(w, 0) + 1
        kept = [w for w, n in seen.items() if n >= min_docs]
        v = len(kept)
        total = {s: sum(c.get(w, 0) for w in kept) for s, c in count.items()}
        p = lambda n, whole: 1 + 10**9 * (n + 5) // (whole + 5 * v)  # noqa: E731, B023
        q = {w: p(sum(c.get(w, 0) for c in count.values()), sum(total.values())) for w in kept}
        for s, c in count.items():
            mine = {w: p(c.get(w, 0), total[s]) for w in kept}
            pairs = [(-sum(abs(mine[w] - p(count[o].get(w, 0), total[o])) for w in kept), o.encode()) for o in count if o != s]
            terms = [(q[w] - mine[w], w.encode()) for w in kept if c.get(w, 0) and mine[w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, o.decode(), -f, k + 1) for k, (f, o) in enumerate(found)]
    return sorted(out)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(k % 9, *r, "clash", 1.0) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, value double")
    return sorted(map(tuple, divergence.divergence(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus():
    r = np.random.default_rng(5)
    words = ["the", "The", "river", "süß", "ÜBER", "über", "naïve", "日本語", "x", "don", "ZEBRA", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))]
    rows = []
    for k in range(900):
        n = int(r.integers(0, 60))
        pick = (r.zipf(1.3, n) + (k % 7)) % len(words)
        rows.append(("'-1 ".join(words[j] for j in pick), ("en", "de", None)[k % 3 if k % 10 else 0], ("hot", "a", "b", "é", None)[0 if k % 3 == 0 else k % 5]))
    return rows


def test_same_as_plain_code(spark):
    rows = corpus() + [("", "xx", "only"), (None, "yy", "p"), ("word", "yy", "q"), ("z " * 200_000, "en", "long"), (None, None, None)] + [("the repeated row", "en", "a")] * 40
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize(("term_block", "group_block", "cells"), [(8, 2, 50), (1, 1, 1), (1024, 256, 3000)])
def test_blocks_of_any_size(spark, monkeypatch, term_block, group_block, cells):
    for name, value in (("TERM_BLOCK", term_block), ("GROUP_BLOCK", group_block), ("CELLS", cells), ("HELD_TERMS", 20)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()[:300] + [("nothing alike", "en", f"s{k}") for k in range(3)]
    assert got(spark, rows, min_docs=12, top=4) == plain(rows, 12, 4)


def test_empty_tables_and_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [("a b", "en", "s")] * 3) == []
    assert got(spark, [("a b", "en", "s"), ("", "en", "t")]) == plain([("a b", "en", "s"), ("", "en", "t")]) != []


def test_ties_go_by_bytes(spark):
    rows = [(" ".join(chr(c) for c in range(0xE0, 0x100) if c not in (0xF7,)) + " 😀 zz aa", "en", "left")] * 30 + [("other", "en", "right")] * 30
    assert got(spark, rows, top=5) == plain(rows, top=5)


def test_shares_are_exact_for_large_counts():
    r = np.random.default_rng(1)
    for _ in range(300):
        total = int(r.integers(1, 2**52))
        n, v = int(r.integers(0, total)), int(r.integers(1, 10**6))
        assert divergence.shares(np.array([n]), np.array([total]), v)[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)
