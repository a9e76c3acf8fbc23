import hashlib
import io
import zlib

import numpy as np
import pytest

from tiermeter.llm import media


def brute_resize(pixels, h, w):
    big = np.kron(pixels.astype(float), np.ones((h, w)))
    rows, cols = pixels.shape
    return np.rint(big.reshape(h, rows, w, cols).mean(axis=(1, 3))).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (33, 64), (64, 9)])
@pytest.mark.parametrize("band", [3, 4096])
def test_area_resize_is_the_mean_over_areas(shape, band, monkeypatch):
    monkeypatch.setattr(media, "BAND_ROWS", band)
    pixels = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    got = media.area_resize(pixels, 8, 9).astype(int)
    assert np.abs(got - brute_resize(pixels, 8, 9).astype(int)).max() <= 1


def test_formats_come_back():
    p = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.array_equal(media.decode(media.encode_ppm(p)), p)
    assert np.array_equal(media.decode(media.encode_bmp(p)), p)
    assert np.array_equal(media.decode(media.encode_ppm(p[:, :, 0])), p[:, :, 0])
    assert media.decode(b"P2 # note\n2 1 # more\n255\n 3 4").tolist() == [[3, 4]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P3\n1 1\n15\n15 0 5").tolist() == [[[255, 0, 85]]]


def test_bad_bytes_are_reported(spark):
    good = media.encode_ppm(np.zeros((2, 2, 3), np.uint8))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"P6\n9 9\n255\nxx")), (3, bytearray(b"GIF89a")), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_columns(rows, "media", "doc_id").collect()}
    assert got[1].height == 2 and np.load(io.BytesIO(got[1].tile)).shape == (16, 16, 3) and got[1].error is None
    assert all(got[k].height is None and got[k].error for k in (2, 3, 4))


def test_texts_come_back(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 500, 5: "z" * 192, 6: "long text " * 30000}
    d = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(None, "abc", 2)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in media.text_media(d).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        body = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        assert r.media_bytes > len(body)
    assert got[None].feature == got[1].feature and got[2].media_sha256 == got[3].media_sha256
    assert media.text_media(d.limit(0)).count() == 0


@pytest.mark.parametrize(("masks", "bits", "word"), [((0xFF, 0xFF00, 0xFF0000), 32, 10 | 20 << 8 | 30 << 16), ((0xFF0000, 0xFF00, 0xFF), 32, 10 << 16 | 20 << 8 | 30), ((0x3FF, 0x3FF << 10, 0x3FF << 20), 32, 40 | 80 << 10 | 120 << 20)])
def test_channel_masks(masks, bits, word):
    import struct

    head = b"BM" + struct.pack("<IHHI", 14 + 40 + 12 + 8, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, 3, 8, 0, 0, 0, 0) + struct.pack("<3I", *masks)
    assert media.decode(head + struct.pack("<2I", word, word)).tolist() == [[[10, 20, 30]] * 2]


def test_five_six_five():
    import struct

    head = b"BM" + struct.pack("<IHHI", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 3, 4, 0, 0, 0, 0) + struct.pack("<3I", 0xF800, 0x7E0, 0x1F)
    assert media.decode(head + struct.pack("<2H", 0xF800, 0x7E0)).tolist() == [[[255, 0, 0], [0, 255, 0]]]


def test_clashing_kept_columns(spark):
    d = spark.createDataFrame([("a", 1, "t", bytearray(media.encode_ppm(np.zeros((2, 3, 3), np.uint8))))], "text string, height long, tile string, media binary")
    row = media.media_columns(d, "media", "text", "height", "tile").first()
    assert row.text == "a" and row.height == 2 and row.width == 3 and isinstance(row.tile, bytearray | bytes)


@pytest.mark.parametrize("data", [
    b"P5\n99999999999999999999 1\n255\n", b"P6\n4000000000 4000000000\n255\nabc", b"P4\n9999999999 99999999\n\0", b"P1\n1000000000 1000000000\n1", b"P3\n4000000000 4000000000\n255\n1 2 3",
    b"P2\n1 1\n255\n" + b"9" * 30, b"P2\n2 1\n255\n1 -1", b"P2\n1 1\n255\n" + b"9" * 5000, b"P2\n2 1\n7\n1 8", b"P5\n2 1\n7\n\x01\x08", b"P1\n2 1\n0 2",
    b"P5 -3 2 255\nabcdef", b"P5 0 2 255\n", b"P6 x 2 255\n", b"P5\n1 1\n0\na", b"P5\n1 1\n99999\na", b"P5\n1 1\n" + b"9" * 5000 + b"\na", b"P5\n2 2\n65535\nabcdef", b"P5", b"P9\n1 1\n", b"BM", b"BM" + b"\xff" * 70,
    media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:18] + b"\xff\xff\xff\x7f" * 2 + media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[26:], media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:18] + b"\0\0\0\x80" * 2 + media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[26:],
])
def test_bad_headers_are_errors_in_their_rows(data):
    out = media._decoded({"text": [data, media.encode_ppm(np.ones((2, 3), np.uint8))]}, (), 4)
    assert out["error"][0] and out["width"] == [None, 3] and out["error"][1] is None


def test_bad_headers_do_not_end_the_job(spark):
    rows = [(b"P6\n4000000000 4000000000\n255\nabc",), (b"P2\n1 1\n255\n" + b"9" * 30,), (media.encode_ppm(np.ones((2, 3), np.uint8)),)]
    got = media.media_columns(spark.createDataFrame(rows, "media binary")).collect()
    assert [r.width for r in got if r.error is None] == [3] and len(got) == 3
