import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiermeter.llm import binary_output, packing, tokens

PATH = tokens.tokenizer_path()
ODD = ["don't. WON'T., x|y a||b, <|endoftext|> a<|endoftext|>. b<|ENDOFTEXT|>, \x1c! a\x1cb\x85c\xa0d é. É., İ.,ſ. 12.5, ...,, .a, ,| |  z ß. \x0b\x0c\r\n q", "日本語。テスト.,", "a" * 3000 + ".", "", " \n", "été ÿ ö÷ü é."]


def library(text: str) -> list[int]:
    return tokens.encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def own(text: str) -> list[int]:
    return tokens.encoder(PATH).ids(pa.array([text]))[0].tolist()


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(text):
    assert own(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcé É.,'|<>1 \n\t\x1ćKİ"), max_size=60))
def test_ids_of_any_text(text):
    assert own(text) == library(text)


def test_full_table_is_emptied_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP_WORDS", 20)
    monkeypatch.setattr(tokens, "SPARE_WORDS", 20)
    enc = tokens.WordEncoder(PATH)
    for k in range(30):
        text = " ".join(f"Word{k * 7 + j}x." for j in range(15))
        assert enc.ids(pa.array([text]))[0].tolist() == library(text)


def test_long_texts_are_cut_at_white_space():
    text = b"alpha beta, gamma. " * 5000
    parts = tokens.safe_cuts(text, 1000)
    assert b"".join(parts) == text and all(p[:1] == b" " for p in parts[1:])
    assert tokens.safe_cuts(b"x" * 5000, 1000) == [b"x" * 5000]
    assert tokens.safe_cuts(b"") == [b""]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id long")


CASES = [(1, "one two"), (2, None), (3, ""), (None, "x."), (1, "one two"), (4, "word " * 5000), (5, "  \n")]


def test_counts(spark):
    d = docs(spark, [(i, t, "clash", 0) for i, t in CASES])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(d).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 2048) for i, t in CASES)
    assert got == want
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def check_pieces(rows, texts):
    by_row = {}
    for r in rows:
        by_row.setdefault(r.sequence_id, []).append(r)
    for pieces in by_row.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*library(text or ""), 1], dtype="<u4")
        at = 0
        for r in sorted(total[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return by_row


def test_packing_is_lossless_and_tight(spark):
    texts = {k: ("w%d " % k) * (k * 37 % 900) for k in range(200)} | {500: "long " * 7000, 501: None, 502: ""}
    rows = packing.digests(packing.pack(docs(spark, [(k, t, "", 0) for k, t in texts.items()]).coalesce(1))).collect()
    sequences = check_pieces(rows, texts)
    sizes = [sum(r.length for r in p) for p in sequences.values()]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padded <= 2048
    per_group = {}
    for p in sequences.values():
        per_group.setdefault(p[0].step_group, []).append(p[0].tier)
    assert all(len(set(t)) == 1 and sum(t) <= packing.GROUP_TOKENS for t in per_group.values())


def test_packing_in_small_blocks_and_with_repeats(spark):
    rows = [(1, "same text here", "", 0)] * 3 + [(None, "x", "", 0)]
    got = packing.pack(docs(spark, rows).coalesce(1), block_tokens=4).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 3 * (len(library("same text here")) + 1)
    assert sum(r.length for r in got if r.doc_id is None) == len(library("x")) + 1
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_tiers_hold_every_token_once(lengths):
    full, rest = packing.pack_tiers([(d, 0, n) for d, n in enumerate(lengths)], last=True)
    assert not rest
    seen = sorted((d, s, n) for _, w in full for d, s, n in w)
    at = {}
    for d, s, n in seen:
        assert s == at.get(d, 0)
        at[d] = s + n
    assert at == dict(enumerate(lengths))
    assert sum(sum(p[2] for p in w) != t for t, w in full) <= 1


def test_best_fit_decreasing():
    assert [sorted(r) for r in binary_output.best_fit_decreasing([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500).tolist()
    rows = binary_output.best_fit_decreasing(lengths, 100)
    assert sorted(i for r in rows for i in r) == list(range(500))
    assert all(sum(lengths[i] for i in r) <= 100 for r in rows)
    # plain best fit, by looking at every row
    room, want = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [k for k, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(100 - n)
            want += 1
    assert len(rows) == want


def test_rows_come_back_whole(spark):
    texts = {k: ("v%d " % k) * (k * 31 % 700) for k in range(120)} | {500: "long " * 5000, 501: None}
    rows = binary_output.write_rows(docs(spark, [(k, t, "", 0) for k, t in texts.items()])).collect()
    back = {}
    for r in rows:
        line = np.frombuffer(r.ids, dtype="<u2")
        assert len(line) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert not line[r.n_tokens :].any()
        for a, z, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=False):
            back.setdefault(d, {})[s] = line[a:z].tolist()
    for d, text in texts.items():
        assert sum((back[d][s] for s in sorted(back[d])), []) == [*library(text or ""), 1]
    assert binary_output.write_rows(docs(spark, [])).count() == 0
