import hashlib
import math
import random
from fractions import Fraction

import pytest

from tiermeter.llm import vector_codes
from tiermeter.llm.vector_codes import ENTRIES, PARTS, ROUNDS


def plain(rows):
    """rows: (vec_id, vector, label). Python's integers throughout."""
    ok = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return []
    dim = len(min(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[1])
    width = -(-dim // PARTS)
    ok = [r for r in ok if len(r[1]) == dim]
    whole = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (width * PARTS - dim) for _, v, _ in ok]
    first = {}
    for (i, v, _), q in sorted(zip(ok, whole, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1])):
        first.setdefault(i, q)
    part = lambda q, p: q[p * width : (p + 1) * width]
    books = [[part(q, p) for q in list(first.values())[:ENTRIES]] for p in range(PARTS)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: [min((far(part(q, p), c), e) for e, c in enumerate(books[p])) for p in range(PARTS)]
    for _ in range(ROUNDS):
        codes = [near(q) for q in whole]
        for p in range(PARTS):
            for e in range(len(books[p])):
                own = [part(q, p) for q, c in zip(whole, codes, strict=True) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    final = [near(q) for q in whole]
    error = [min(sum(d for d, _ in c), vector_codes.LARGEST) for c in final]
    by_label = {}
    for (_, _, lab), e in zip(ok, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted((repr(i), "".join(f"{e:02x}" for _, e in c), err, min(by_label[lab], vector_codes.LARGEST), sha) for (i, _, lab), c, err in zip(ok, final, error, strict=True))


def codes(spark, rows, kind="float"):
    frame = spark.createDataFrame([(lab, i, v, "clash") for i, v, lab in rows], f"label int, vec_id long, embedding array<{kind}>, code string")
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.codes(frame).collect())


def drawn(n, dim, seed=3, scale=1.0):
    r = random.Random(seed)
    return [(k * 3, [round(r.gauss(0, 1) * 64) / 64 * scale for _ in range(dim)], r.randrange(3)) for k in range(n)]


def test_same_as_plain_code(spark):
    rows = drawn(120, 16)
    rows += [(1, None, 1), (2, [], 1), (4, [0.5] * 15 + [None], 1), (5, [0.5] * 15 + [math.nan], 1), (7, [math.inf] + [0.0] * 15, 2), (8, [1.0] * 8, 2)]
    rows += [(None, [0.25] * 16, None), (None, [-0.25] * 16, None), (3, rows[5][1], 0), (3, [-9.0] * 16, 1), *[rows[7]] * 30]
    random.Random(1).shuffle(rows)
    assert codes(spark, rows) == plain(rows)


def test_lengths_that_do_not_divide_and_few_rows(spark):
    for n, dim in ((5, 8), (40, 11), (1, 3)):
        assert codes(spark, drawn(n, dim)) == plain(drawn(n, dim)), (n, dim)


@pytest.mark.parametrize("scale", [2.0**34, 1e305])
def test_large_components_are_exact(spark, scale):
    rows = drawn(40, 8, scale=scale)
    assert codes(spark, rows, "double") == plain(rows)


def test_all_equal_and_none(spark):
    rows = [(k, [0.5] * 8, None) for k in range(40)]
    assert codes(spark, rows) == plain(rows) and {r[1] for r in codes(spark, rows)} == {"00" * 8}
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1), (2, [], 2)]) == []


def test_labels_in_numbers_are_joined_by_shuffling(spark, monkeypatch):
    from tiermeter.llm import graph

    monkeypatch.setattr(graph, "HOT_KEYS", 4)
    rows = [(i, v, None if i % 2 else i % 40) for i, v, _ in drawn(100, 8)]
    assert codes(spark, rows) == plain(rows)


def test_later_rounds_shuffle_only_what_changed(spark, monkeypatch):
    seen = []
    whole = vector_codes.written

    def watched(df, label):
        out = whole(df, label)
        if label == "codes":
            seen.append((out.where("part is null").count(), sum(r.value for r in out.where("component = -1").collect())))
        return out

    monkeypatch.setattr(vector_codes, "written", watched)
    rows = [(k, [float(k % 16)] * 8, 0) for k in range(160)]
    codes(spark, rows)
    # every part joins once; then nothing moves, and the last round keeps no state
    assert seen == [(160, 160 * PARTS)] + [(160, 0)] * (ROUNDS - 2) + [(0, 0)]
