"""Quality scores from document statistics (op 5).

Statistics of a text go through random Fourier features, which approximate a
Gaussian kernel. Partitions sum their normal equations, the driver solves the
ridge system of fixed size, and an isotonic map turns raw scores into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_map, arrow_schema, tidied, with_bytes, written
from tiermeter.llm.kernels import Batch, keyed, repeats, windows
from tiermeter.llm.labelled import fold, held_out, sample

#: Labelled rows to learn from, at most; their share for calibration is one fold of four.
LABELLED_ROWS = 20_000
FEATURES, RIDGE, SEED = 256, 1e-4, 20240229
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b".,;:?'\"-()")] = True
N_STATS = 16


def statistics(texts: list[bytes]) -> np.ndarray:
    """``N_STATS`` bounded statistics of each text; all zero for a text without words."""
    b = Batch(texts)
    out = np.zeros((b.n, N_STATS))
    size = np.maximum(b.ends - b.begins, 1)
    words = np.maximum(b.n_words, 1)
    buf = b.buf
    upper = (buf >= 65) & (buf <= 90)
    for k, mask in enumerate((SYMBOLS[buf], upper, buf == 33, (buf >= 48) & (buf <= 57), MARKS[buf], buf >= 128, b.space)):
        out[:, k] = b.per_doc(mask) / size
    hashes = b.words()
    _, before = repeats(keyed(hashes, b.doc))
    out[:, 7] = np.bincount(b.doc[before], minlength=b.n) / words
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (b.doc[1:] == b.doc[:-1]))
    out[:, 8] = np.bincount(b.doc[same], minlength=b.n) / words
    tri, at = windows(hashes, b.doc, 3)
    _, before = repeats(keyed(tri, b.doc[at]))
    out[:, 9] = np.bincount(b.doc[at[before]], minlength=b.n) / words
    start, end, doc = b.lines()
    full = end > start
    start, end, doc = start[full], end[full], doc[full]
    _, before = repeats(keyed(b.hashes(start, end), doc))
    lines = np.bincount(doc, minlength=b.n)
    out[:, 10] = np.bincount(doc[before], minlength=b.n) / np.maximum(lines, 1)
    length = b.end - b.start
    out[:, 11] = np.bincount(b.doc, weights=length, minlength=b.n) / words / 20
    out[:, 12] = np.bincount(b.doc[length == 1], minlength=b.n) / words
    out[:, 13] = np.log1p(b.n_words) / 10
    out[:, 14] = np.log1p(words / np.maximum(lines, 1)) / 10
    first = buf[b.start]
    out[:, 15] = np.bincount(b.doc[(first >= 65) & (first <= 90)], minlength=b.n) / words
    out[b.n_words == 0] = 0
    return np.minimum(out, 2)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of labels to scores, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    values, at = np.unique(score[order], return_index=True)
    weight = np.diff(np.append(at, len(score))).astype(float)
    mean = np.add.reduceat(label[order].astype(float), at) / weight if len(at) else np.empty(0)
    blocks: list[list[float]] = []  # mean, weight, first, last
    for m, w, x in zip(mean, weight, values, strict=True):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([y for b in blocks for y in (b[0], b[0])])
    return xs, ys


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.beta

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.raw(statistics(texts))
        if not len(self.knots[0]):
            return np.clip(raw, 0, 1)
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    width = np.sqrt(N_STATS)
    frequencies = rng.standard_normal((N_STATS, FEATURES)) / width
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack((np.sqrt(2 / FEATURES) * np.cos(x @ frequencies + phase), np.ones((len(x), 1))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``bound`` labelled rows outside the held-out fold.

    Fold 3 of 4 calibrates; folds 0 and 1 give the ridge fit. Without labels
    every score is 0.5; with one class only it is that class.
    """
    rows = sample(docs, labels, label, bound).withColumn("calibrate", (fold("doc_id", 4) == 3).cast("int"))
    schema = "label int, calibrate int, stats array<double>"
    table = written(arrow_map(rows.select("label", "calibrate", "text"), lambda c: {"label": c["label"], "calibrate": c["calibrate"], "stats": list(statistics(c["text"]))}, schema), "quality-stats").coalesce(8)
    moments = table.where("calibrate = 0").select([F.struct(F.avg(F.col("stats")[k]), F.stddev_pop(F.col("stats")[k])).alias(f"m{k}") for k in range(N_STATS)]).first()
    mean = np.array([m[0] or 0.0 for m in moments])
    scale = np.array([max(m[1] or 0.0, 1e-3) for m in moments])
    target = arrow_schema("a binary, b binary, n double")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            if batch.num_rows:
                z = fourier(np.array(batch.column("stats").to_pylist()), mean, scale)
                a += z.T @ z
                b += z.T @ np.asarray(batch.column("label"), dtype=float)
                n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([float(n)])], schema=target)

    a, b, n = np.zeros((FEATURES + 1) ** 2), np.zeros(FEATURES + 1), 0.0
    for part in table.where("calibrate = 0").mapInArrow(sums, "a binary, b binary, n double").collect():  # 8 at most
        a, b, n = a + np.frombuffer(part.a), b + np.frombuffer(part.b), n + part.n
    a = a.reshape(FEATURES + 1, FEATURES + 1)
    penalty = np.full(FEATURES + 1, RIDGE * max(n, 1))
    penalty[-1] = 1e-9
    beta = np.linalg.solve(a + np.diag(penalty), b) if n else np.append(np.zeros(FEATURES), 0.5)
    model = Model(mean, scale, beta, (np.empty(0), np.empty(0)))
    pairs = table.where("calibrate = 1").toArrow()  # at most the bound
    if not pairs.num_rows:
        return model
    raw = model.raw(np.array(pairs.column("stats").to_pylist()))
    return Model(mean, scale, beta, isotonic(raw, np.asarray(pairs.column("label"))))


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row.

    Null and empty texts score as a text without words; a null ``doc_id`` stays
    null and isn't held out; repeated rows score alike; an empty table gives an
    empty result.
    """
    rows = with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = arrow_map(rows, lambda c: {"doc_id": c["doc_id"], "score": model.score(c["text"])}, SCHEMA)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t.encode() if t is not None else b"" for t in batch.column("text").to_pylist()]
                keep = np.concatenate([model.score(part) for part in _parts(texts)]) >= threshold
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)


def _parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part
