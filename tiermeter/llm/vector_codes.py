"""Compressing vectors to product codes by delta-maintained Lloyd rounds (op 12).

Vectors become integers and are cut into equal parts; each part position has a
codebook. A round is one narrow pass in Arrow batches: it reads each vector with
the codes of the round before from the state table, assigns its parts anew, and
writes the next state table. Beside the vectors a task writes what it changed:
for each part whose code changed, minus the part at its old entry and plus it at
the new one, summed within the task. Only these sums are shuffled; they are added
to the running sums, a written table of one row for each component of an entry,
from which the next codebooks come. Codebooks have a fixed size (parts x entries
x width), so they travel with the code.

All arithmetic is exact: in doubles where every number stays below 2^52, else in
Python's integers. Sums are kept as 32-bit limbs, so they have no largest value.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermeter.llm.common import tidied, written
from tiermeter.llm.graph import hot_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Below this, sums of squares of integers are exact in doubles.
EXACT = 1 << 52
LIMB = 32
LARGEST = (1 << 63) - 1
#: A row for each limb of a component of an entry's sum; component -1 is the count.
SUMS = "part int, entry int, component int, limb int, value long"


@dataclass(frozen=True)
class Codebooks:
    """Entries by part and index, as integers; ``dim`` is the length of the vectors (0: none seen)."""

    dim: int
    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def width(self) -> int:
        return -(-self.dim // PARTS)

    def sha256(self) -> str:
        """Hash of all components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def usable(vectors: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """Rows with a vector (of length ``dim``) without null or non-finite components; ``column`` as floating point numbers."""
    of = vectors.schema[column].dataType.elementType
    v = F.col(f"`{column}`") if isinstance(of, (T.FloatType, T.DoubleType)) else F.col(f"`{column}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    length = F.size(v) > 0 if dim is None else F.size(v) == dim
    return vectors.where(F.col(f"`{column}`").isNotNull() & length & ~F.coalesce(odd, F.lit(False))).withColumn(column, v)


def quantised(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors in ``flat`` by part, in doubles or (where those aren't exact) integers."""
    width = -(-dim // PARTS)
    x = flat.astype(np.float64).reshape(-1, dim)
    if len(x) and np.abs(x).max() >= (1 << 50) / SCALE:
        x = np.array([[math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in row] for row in x.tolist()], dtype=object)
    else:
        x = np.floor(x * SCALE)
    if width * PARTS > dim:
        x = np.concatenate((x, np.zeros((len(x), width * PARTS - dim), dtype=x.dtype)), axis=1)
    return x.reshape(-1, PARTS, width)


def nearest(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each part (ties: the lowest), and its squared distance."""
    entries = np.array(books.entries, dtype=object)
    top = max([0, *(abs(c) for c in entries.ravel())])
    reach = (top + (int(np.abs(x).max()) if len(x) else 0)) ** 2 * books.width
    if reach < EXACT:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        cross = np.einsum("npw,pew->npe", x, entries, optimize=True)
        far = (x * x).sum(-1)[:, :, None] - 2 * cross + (entries * entries).sum(-1)[None]
    else:
        whole = np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
        far = ((whole[:, :, None, :] - entries[None]) ** 2).sum(-1)
    at = np.argmin(far, axis=2)
    return at, np.take_along_axis(far, at[:, :, None], axis=2)[:, :, 0]


class Changes:
    """Sums of the parts that left or joined an entry, within a task."""

    def __init__(self, n_entries: int, width: int):
        self.sums = np.zeros((PARTS, n_entries, width + 1), dtype=object)

    def add(self, x: np.ndarray, entry: np.ndarray, moved: np.ndarray, sign: int) -> None:
        """Add ``sign`` times the parts of ``x`` at ``entry`` where ``moved``; the last component counts them."""
        row, part = np.nonzero(moved)
        if not len(row):
            return
        values, at = x[row, part], entry[row, part]
        if values.dtype != object and np.abs(values).max() * len(row) >= EXACT:
            values = np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)
        block = np.zeros(self.sums.shape, dtype=object if values.dtype == object else np.float64)
        np.add.at(block, (part, at, slice(None, -1)), values)
        np.add.at(block, (part, at, -1), 1)
        place = np.nonzero(block.any(axis=2))
        self.sums[place] += sign * np.array([[int(v) for v in row] for row in block[place]], dtype=object)

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        width = self.sums.shape[2] - 1
        for part, entry, k in zip(*np.nonzero(self.sums), strict=True):
            value, limb = int(self.sums[part, entry, k]), 0
            while value:
                last = -(1 << LIMB) < value < 1 << LIMB
                low = value if last else value & ((1 << LIMB) - 1)
                yield int(part), int(entry), -1 if k == width else int(k), limb, low
                value, limb = (value - low) >> LIMB, limb + 1


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _round(state: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """State rows (``v``, ``code``) with new codes, none of them in the ``last`` round, and rows of ``SUMS`` for what changed."""
    schema = T.StructType([T.StructField("v", state.schema["v"].dataType), T.StructField("code", T.BinaryType()), *T._parse_datatype_string(SUMS).fields])
    of = pa.float32() if isinstance(state.schema["v"].dataType.elementType, T.FloatType) else pa.float64()
    target = pa.schema([("v", pa.list_(of)), ("code", pa.binary()), *((n, pa.int32()) for n in ("part", "entry", "component", "limb")), ("value", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes = Changes(len(books.entries[0]), books.width)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = quantised(_flat(batch, "v"), books.dim)
            now, _ = nearest(x, books)
            codes = batch.column("code")
            if codes.null_count:  # the first round
                moved = np.ones(now.shape, dtype=bool)
            else:
                before = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(n, PARTS).astype(np.int64)
                moved = now != before
                changes.add(x, before, moved, -1)
            changes.add(x, now, moved, 1)
            if not last:
                code = now.astype(np.uint8).tobytes()
                new = pa.array([code[i * PARTS : (i + 1) * PARTS] for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("v").cast(target.field("v").type), new, *(pa.nulls(n, f.type) for f in list(target)[2:])], schema=target)
        rows = list(changes.rows())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), target.field("v").type), pa.nulls(len(rows), pa.binary()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(target)[2:], strict=True))], schema=target)

    return state.mapInArrow(tidied(run), schema)


def _first(rows: DataFrame, by: str, column: str) -> list[list[float]]:
    """Vectors of the ``ENTRIES`` smallest distinct ids (a null one last); of an id's vectors the smallest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[float]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                k = (i is None, i if i is not None else 0)
                best[k] = min(v, best.get(k, v))
            best = {k: best[k] for k in heapq.nsmallest(ENTRIES, best)}
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([None if k[0] else k[1] for k in best], schema.field("id").type), pa.array(best.values(), schema.field("v").type)], schema=schema)

    pairs = rows.select(F.col(f"`{by}`").alias("id"), F.col(f"`{column}`").alias("v"))
    found = pairs.mapInArrow(tidied(run), pairs.schema).groupBy("id").agg(F.min("v").alias("v"))  # ENTRIES rows of each task
    return [r.v for r in found.orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()]


def train(vectors: DataFrame, by: str = "vec_id", column: str = "embedding", rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of Lloyd over all usable vectors, starting from those of the smallest ids.

    The length of vectors is that of the smallest usable (id, vector); others
    are left out. One that isn't a multiple of ``PARTS`` is filled up with
    zeros. Of fewer than ``ENTRIES`` ids there are as many entries. Without
    usable vectors the codebooks are empty.
    """
    known = usable(vectors, column)
    first = known.agg(F.min(F.struct(F.col(f"`{by}`").isNull().alias("none"), F.col(f"`{by}`").alias("id"), F.col(f"`{column}`").alias("v"))).alias("low")).first()["low"]
    if first is None:
        return Codebooks(0, ((),) * PARTS)
    dim = len(first["v"])
    rows = usable(vectors, column, dim)
    start = quantised(np.array(_first(rows, by, column), dtype=np.float64), dim)
    books = Codebooks(dim, tuple(tuple(tuple(int(x) for x in start[e, p]) for e in range(len(start))) for p in range(PARTS)))
    state = rows.select(F.col(f"`{column}`").alias("v"), F.lit(None).cast("binary").alias("code"))
    sums: DataFrame | None = None
    names = [f.split()[0] for f in SUMS.split(", ")]
    for k in range(rounds):
        table = written(_round(state, books, k == rounds - 1), "codes")
        change = table.where("part is not null").select(*names)
        whole = change if sums is None else sums.union(change)
        sums = written(whole.groupBy(*names[:-1]).agg(F.sum("value").alias("value")), "sums")
        state = table.where("part is null").select("v", "code")
        books = _moved(books, sums)
    return books


def _moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each used entry at its parts' mean, rounded down; ``sums`` has a row for each limb of a component."""
    total: dict[tuple[int, int, int], int] = {}
    for r in sums.collect():  # PARTS x ENTRIES x width components
        at = (r["part"], r["entry"], r["component"])
        total[at] = total.get(at, 0) + (r["value"] << LIMB * r["limb"])

    def entry(p: int, e: int) -> tuple[int, ...]:
        n = total.get((p, e, -1), 0)
        return tuple(total.get((p, e, c), 0) // n for c in range(books.width)) if n else books.entries[p][e]

    return Codebooks(books.dim, tuple(tuple(entry(p, e) for e in range(len(books.entries[p]))) for p in range(PARTS)))


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (two hexadecimal digits for each part) and ``error``, the summed squared distances.

    An error beyond the largest long is given as that. Columns of these names
    are replaced. Codes can be read without their vectors: the entry of each
    part is the nearest one's.
    """
    out = vectors.drop("code", "error")
    rows = usable(out, column, books.dim or -1)
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, far = nearest(quantised(_flat(batch, column), books.dim), books)
            digits = at.astype(np.uint8).tobytes().hex()
            error = [min(int(e), LARGEST) for e in far.sum(axis=1)] if far.dtype == object else far.sum(axis=1).astype(np.int64)
            code = [digits[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*batch.schema.names, "code", "error"])

    return rows.mapInArrow(tidied(run), schema)


def _clamped(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` (a written table) with ``label_error``: the error summed over equal labels, null ones together.

    Sums come from one aggregation. Labels with many rows are broadcast, the others joined by shuffling.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{label}`").cast("string")), F.lit("null"))
    rows = coded.drop("label_error").withColumn("__label", name)
    sums = written(rows.groupBy("__label").agg(_clamped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("__rows")), "labels")
    total = sums.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    return hot_join(rows, sums, "__label", "__rows", total, "inner").drop("__label", "__rows")


def codes(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable row.

    Rows that repeat an id are coded like others and weigh as often in the
    means; an empty table gives no rows.
    """
    books = train(vectors)
    coded = written(encode(vectors.select("vec_id", "label", "embedding"), books).select("vec_id", "label", "code", "error"), "coded")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    return f"SELECT n, p, min(far * {ENTRIES} + e) AS best FROM (SELECT n, p, e, sum((x - c) * (x - c)) AS far FROM comp JOIN {book} USING (p, j) GROUP BY n, p, e) GROUP BY n, p"


def _oracle() -> str:
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT n, vec_id, (k - 1) // (len(v) // {PARTS}) AS p, (k - 1) % (len(v) // {PARTS}) AS j, CAST(floor({SCALE} * CAST(v[k] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT n, vec_id, v, unnest(generate_series(1, len(v))) AS k FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, e, j, x AS c FROM comp JOIN (SELECT n, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (n) WHERE e < {ENTRIES}
)"""]  # fmt: skip
    for k in range(1, ROUNDS + 1):
        parts.append(f"""
codes{k} AS MATERIALIZED ({_assigned(f"book{k - 1}")}), sums{k} AS MATERIALIZED (
  SELECT p, CAST(best % {ENTRIES} AS BIGINT) AS e, j, sum(x) AS s, count(*) AS m FROM comp JOIN codes{k} USING (n, p) GROUP BY ALL
), book{k} AS MATERIALIZED (
  SELECT p, e, j, CASE WHEN m IS NULL THEN c ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END AS c FROM book{k - 1} LEFT JOIN sums{k} USING (p, e, j)
)""")
    parts.append(f"""
final AS MATERIALIZED ({_assigned(f"book{ROUNDS}")}), coded AS MATERIALIZED (
  SELECT vec_id, label, code, error FROM kept JOIN (
    SELECT n, string_agg(format('{{:02x}}', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM final GROUP BY n) USING (n)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
""")
    return ",".join(parts)


ORACLE = _oracle()
