"""Quality rules with a hashed n-gram classifier (op 10).

Fixed rules on words, lines and symbols reject a text first. For the rest, a
logistic regression on hashed word and character n-grams gives a calibrated
probability of good quality, held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_map, arrow_schema, tidied, with_bytes
from tiermeter.llm.kernels import Batch, keyed, repeats, windows
from tiermeter.llm.labelled import fold, sample
from tiermeter.llm.quality import SYMBOLS

#: Labelled rows to learn from, at most; one task fits them.
LABELLED_ROWS = 4_000
BITS, CHARS, WORDS = 18, (3, 4), (1, 2)
STEPS, RATE, GAIN, DECAY = 60, 0.5, 40.0, 1e-6
#: Probability from which a text is kept.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50


def grams(b: Batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed features in text order, and each text's first and last."""
    for n in CHARS:
        m = max(len(b.buf) - n + 1, 0)
        value = b.buf[:m].astype(np.uint32)
        for k in range(1, n):
            value = value * np.uint32(0x01000193) + b.buf[k : k + m]
        value *= np.uint32(0x9E3779B1)
        yield value >> np.uint32(32 - BITS), b.begins, np.maximum(b.ends - n + 1, b.begins)
    words = b.words()
    for n in WORDS:
        value, at = (words, np.arange(len(words))) if n == 1 else windows(words, b.doc, n)
        count = np.bincount(b.doc[at], minlength=b.n)
        last = np.cumsum(count)
        yield ((value ^ np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.uint32), last - count, last


def logits(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    b = Batch(texts)
    out = np.full(b.n, bias)
    for feature, first, last in grams(b):
        total = np.concatenate(([0], np.cumsum(weights[feature], dtype=np.float64)))
        out += GAIN / len((*CHARS, *WORDS)) * (total[last] - total[first]) / np.maximum(last - first, 1)
    return out


def train(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: full gradients with a rate for each weight.

    ``parts`` has (features, texts, values) triples.
    """
    w, grown = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    share = labels.mean() if len(labels) else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(labels) or share in (0, 1):
        return np.append(w, bias)
    side = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
    bias_grown = 1e-8
    for _ in range(STEPS):
        z = np.full(len(labels), bias)
        for feature, text, value in parts:
            z += np.bincount(text, weights=w[feature] * value, minlength=len(labels))
        error = side * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        slope = DECAY * w
        for feature, text, value in parts:
            slope += np.bincount(feature, weights=error[text] * value, minlength=len(w))
        grown += slope**2
        w -= RATE * slope / np.sqrt(grown)
        bias_grown += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(bias_grown)
    return np.append(w, bias)


def counted(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, texts, values) of a batch, with equal features of a text added up."""
    b = Batch(texts)
    for feature, first, last in grams(b):
        text = np.repeat(np.arange(b.n), last - first)
        at = np.repeat(first - np.concatenate(([0], np.cumsum(last - first)[:-1])), last - first) + np.arange(len(text))
        key, count = np.unique(text.astype(np.int64) << BITS | feature[at], return_counts=True)
        text = key >> BITS
        value = count * (GAIN / len((*CHARS, *WORDS)) / np.maximum(last - first, 1))[text]
        yield (key & ((1 << BITS) - 1)).astype(np.int32), text.astype(np.int32), value.astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * logits(texts, self.weights, self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic map from logits to labels, with smoothed targets."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack((z, np.ones_like(z)), axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        theta = theta - np.clip(step, -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``bound`` labelled rows; a quarter of them calibrates.

    The fit is one task over the other rows, in the order of their ids' hashes.
    Without labels every probability is 0.5.
    """
    rows = sample(docs, labels, label, bound).withColumn("calibrate", fold("doc_id", 4) == 3)
    target = arrow_schema("weights binary, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, truth = [], []
        for batch in batches:
            if batch.num_rows:
                first = sum(map(len, truth))
                for feature, text, value in counted(batch.column("text").to_pylist()):
                    parts.append((feature, text + np.int32(first), value))
                truth.append(np.asarray(batch.column("label")))
        y = np.concatenate(truth) if truth else np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array([train(parts, y).astype(np.float32).tobytes()], pa.binary()), pa.array([len(y)])], schema=target)

    share = rows.where("not calibrate").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "label")  # at most the bound
    found = share.mapInArrow(tidied(run), "weights binary, n long").first()
    if found is None or not found.n:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    fitted = np.frombuffer(found.weights, dtype=np.float32)
    weights, bias = fitted[:-1], float(fitted[-1])
    pairs = arrow_map(rows.where("calibrate").select("text", "label"), lambda c: {"z": logits(c["text"], weights, bias), "label": c["label"]}, "z double, label int").toArrow()
    return Model(weights, bias, *platt(np.asarray(pairs.column("z")), np.asarray(pairs.column("label"))))


def base_rules(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of words, word characters, symbols, repeated lines and repeated words."""
    b = Batch(texts)
    letters = ~b.space & ((b.buf & 0xC0) != 0x80)
    start, end, doc = b.lines()
    filled = np.concatenate(([0], np.cumsum(~b.space, dtype=np.int64)))
    full = filled[end] > filled[start]
    start, end, doc = start[full], end[full], doc[full]
    _, before = repeats(keyed(b.hashes(start, end), doc))
    tri, at = windows(b.words(), b.doc, 3)
    twice, _ = repeats(keyed(tri, b.doc[at]))
    covered = np.zeros(len(b.start) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {
        "n_words": b.n_words,
        "word_chars": b.per_doc(letters),
        "n_symbols": b.per_doc(SYMBOLS[b.buf]),
        "n_dup_lines": np.bincount(doc[before], minlength=b.n),
        "n_repeat_words": np.bincount(b.doc[covered[: len(b.start)]], minlength=b.n),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``probability`` for every row.

    A null or empty text has no words and fails the base rules. A null
    ``doc_id`` stays null; repeated rows are judged alike; an empty table gives
    an empty result.
    """

    def run(c: dict[str, list]) -> dict[str, object]:
        out: dict[str, object] = {"doc_id": c["doc_id"], **base_rules(c["text"])}
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
        p = model.probability(c["text"])
        return out | {"base_failed": failed, "kept": ~failed & (p >= keep_from), "probability": p}

    return arrow_map(with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")), run, SCHEMA)
