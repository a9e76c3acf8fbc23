"""Media columns: Netpbm and BMP images as numpy arrays, tiles and hashes (op 1)."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_map, with_bytes

#: Pixels of a row and bytes of a pixel: a row has 192 bytes.
WIDTH, CHANNELS = 64, 3
TILE = 16
#: Rows that the running sums of an image hold at once.
BAND_ROWS = 4096


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of 8-bit samples: P6 for three channels, P5 for one."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP: rows from the bottom, blue first, rows padded to four bytes."""
    height, width = pixels.shape[:2]
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), dtype=np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if m is None:
            raise ValueError("the header is cut off")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if len(head) > 2 else 1
    if not 0 < most < 65536:
        raise ValueError(f"maximum value {most}")
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if channels == 3 else (height, width)
    n, row = width * height * channels, (width + 7) // 8
    # A sample has at least one byte in plain forms; nothing is made before the bytes are known to be there.
    needed = row * height if kind == b"P4" else n * (2 if most > 255 and kind in (b"P5", b"P6") else 1)
    if min(width, height) < 1 or needed > len(data) - at - (kind in (b"P4", b"P5", b"P6")):
        raise ValueError(f"{width} x {height} samples are not there")
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, needed, at + 1).reshape(height, row)
        return (1 - np.unpackbits(bits, axis=1)[:, :width]) * np.uint8(255)
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n], np.uint8) - 48
    elif kind in (b"P2", b"P3"):
        flat = [int(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split(None, n)[:n]]
        if flat and not 0 <= min(flat) <= max(flat) <= most:
            raise ValueError("a sample is out of range")
        flat = np.array(flat, dtype=np.int64)
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(flat) != n:
        raise ValueError("samples are missing")
    if flat.max() > most:
        raise ValueError("a sample is out of range")
    if kind == b"P1":
        return ((1 - flat) * np.uint8(255)).reshape(shape)
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    return flat.astype(np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    (begin,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if (packed, bits) not in ((0, 8), (0, 24), (0, 32), (3, 16), (3, 32)):
        raise ValueError(f"BMP with {bits} bits, compression {packed}")
    up, height = height > 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    if min(width, height) < 1 or row * height > len(data) - begin:
        raise ValueError(f"{width} x {height} pixels are not there")
    raw = np.frombuffer(data, np.uint8, row * height, begin).reshape(height, row)[:: -1 if up else 1]
    if bits == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        colours = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + header).reshape(-1, 4)
        return colours[raw[:, :width], 2::-1]
    step = bits // 8
    if packed == 3:  # the channels' bits are told by masks behind the first 40 bytes of the header
        whole = np.ascontiguousarray(raw[:, : width * step]).view(f"<u{step}").astype(np.int64)
        out = np.zeros((height, width, 3), dtype=np.uint8)
        for k, mask in enumerate(struct.unpack_from("<3I", data, 54)):
            shift = (mask & -mask).bit_length() - 1
            if mask:
                most = mask >> shift
                out[:, :, k] = (((whole & mask) >> shift) * 255 + most // 2) // most
        return out
    return np.ascontiguousarray(raw[:, : width * step].reshape(height, width, step)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    """8-bit samples, height x width (x 3), of Netpbm P1 to P6 or BMP bytes."""
    if data[:2] == b"BM":
        return _bmp(data)
    if re.match(rb"P[1-6]", data):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image read between samples.

    The integral image is built in bands of rows and read only at the target's
    edges, so memory stays bounded for tall images.
    """
    flat = pixels.reshape(*pixels.shape[:2], -1)
    rows, cols, depth = flat.shape
    y_edges, x_edges = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    left = np.minimum(x_edges.astype(np.int64), cols - 1)
    part_x = (x_edges - left)[:, None]
    at_edges = np.zeros((height + 1, width + 1, depth))
    total = np.zeros((1, width + 1, depth))
    done = 0
    for first in range(0, rows, BAND_ROWS):
        band = flat[first : first + BAND_ROWS]
        across = np.zeros((len(band), cols + 1, depth))
        np.cumsum(band, axis=1, out=across[:, 1:])
        at_x = across[:, left] * (1 - part_x) + across[:, left + 1] * part_x
        down = np.concatenate((total, total + np.cumsum(at_x, axis=0)))
        last = first + len(band)
        while done <= height and (y_edges[done] <= last or last == rows):
            y = min(y_edges[done], rows) - first
            k = min(int(y), len(band) - 1)
            at_edges[done] = down[k] * (1 - (y - k)) + down[k + 1] * (y - k)
            done += 1
        total = down[-1:]
    sums = np.diff(np.diff(at_edges, axis=0), axis=1)
    out = sums / ((rows / height) * (cols / width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(height, width, *pixels.shape[2:])


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is each of 8 x 8 grey means less than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else (pixels.astype(np.uint16) @ np.array([77, 150, 29], dtype=np.uint16) >> 8).astype(np.uint8)
    small = area_resize(grey, 8, 9).astype(np.int16)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of a row's bytes."""
    row = WIDTH * CHANNELS
    return text.ljust(max(row, -(-len(text) // row) * row))


def to_media(text: bytes) -> bytes:
    """The payload as an image: BMP where its CRC-32 is odd, else Netpbm."""
    body = payload(text)
    pixels = np.frombuffer(body, np.uint8).reshape(-1, WIDTH, CHANNELS)
    return encode_bmp(pixels) if zlib.crc32(body) & 1 else encode_ppm(pixels)


OUTPUTS = ("height", "width", "samples", "tile", "dhash", "error")


def media_columns(df: DataFrame, media: str = "media", *keep: str, tile: int = TILE) -> DataFrame:
    """Decode a binary column: ``height``, ``width``, ``samples``, ``tile`` (NPY), ``dhash`` and ``error``.

    Bytes that can't be decoded, and nulls, give nulls and an ``error``: sizes
    are held against the bytes before an array is made. A kept
    column called like one of these gives way to it.
    """
    keep = tuple(c for c in keep if c not in OUTPUTS)
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString().replace('bigint', 'long')}" for c in keep)
    schema = (f"{kept}, " if keep else "") + "height int, width int, samples binary, tile binary, dhash string, error string"
    inner = [F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)]
    return arrow_map(df.select(*inner, F.col(media).alias("text")), lambda x: _decoded(x, keep, tile), schema)


def _decoded(columns: dict[str, list], keep: tuple[str, ...], tile: int) -> dict[str, list]:
    out: dict[str, list] = {k: columns[f"kept{i}"] for i, k in enumerate(keep)}
    rows = []
    for data in columns["text"]:
        try:
            if data is None:
                raise ValueError("null")
            pixels = decode(data)
            rows.append((pixels.shape[0], pixels.shape[1], pixels.tobytes(), npy(area_resize(pixels, tile, tile)), f"{difference_hash(pixels):016x}", None))
        except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
            rows.append((None, None, None, None, None, str(e)))
    for name, column in zip(OUTPUTS, zip(*rows, strict=True) if rows else [()] * 6, strict=True):
        out[name] = list(column)
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, height long"


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text as an image, read back, with its features.

    A null or empty text is one row of spaces. A null ``doc_id`` stays null;
    repeated rows give repeated rows; an empty table gives an empty result.
    """

    def run(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        out["doc_id"] = columns["doc_id"]
        for text in columns["text"]:
            stored = to_media(text)
            pixels = decode(stored)
            back = pixels.tobytes()
            tile = npy(area_resize(pixels, TILE, TILE))
            sha = hashlib.sha256(back).hexdigest()
            values = (len(text), len(back), sha, zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(pixels):016x}", hashlib.sha256(tile).hexdigest(), pixels.shape[0])
            for name, v in zip(list(out)[1:], values, strict=True):
                out[name].append(v)
        return out

    return arrow_map(with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")), run, SCHEMA)
