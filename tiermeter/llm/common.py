"""Shared plumbing: Arrow mapping in byte-bounded batches, and written tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy batch holds, unless a single text is longer.
BATCH_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch between the JVM and Python.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


#: Tables that a reused Python worker holds, by owner, and how to drop them.
HELD: dict[str, Callable[[], None]] = {}

Batches = Iterable[pa.RecordBatch]


def tidied(run: Callable[[Batches], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that holds no other operator's tables and gives freed memory back.

    Python workers outlive their tasks; without this, one operator's tables and
    the allocator's free lists stay while the next operator runs.
    """

    def tidy(batches: Batches) -> Iterator[pa.RecordBatch]:
        for name, drop in HELD.items():
            if name != owner:
                drop()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return tidy


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, so that long texts can't fill a worker's memory."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/documents.parquet")


def with_bytes(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns and ``text`` as UTF-8 bytes; a null text is empty."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(*[F.col(c) for c in columns], text.alias("text"))


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, object]], schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Apply ``f`` to batches of rows whose texts add up to about ``batch_bytes``.

    ``f`` gets a dict of Python lists by column and returns a dict of sequences
    (lists or numpy arrays), one for each column of ``schema``.
    """
    names = [part.split()[0] for part in _fields(schema)]
    target = _arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sliced(batches, batch_bytes):
            out = f(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=target.field(n).type) for n in names], schema=target)

    return df.mapInArrow(tidied(run), schema)


def sliced(batches: Iterable[pa.RecordBatch], batch_bytes: int = BATCH_BYTES) -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of lists, cut so that the texts of one stay within ``batch_bytes``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        first, held = 0, 0
        sizes = [len(t or b"") for t in columns["text"]] if "text" in columns else [0] * batch.num_rows
        for i, n in enumerate(sizes):
            if held and held + n > batch_bytes:
                yield {k: v[first:i] for k, v in columns.items()}
                first, held = i, 0
            held += n + 1
        yield {k: v[first:] for k, v in columns.items()}


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _arrow_schema(schema: str) -> pa.Schema:
    def kind(t: str) -> pa.DataType:
        return pa.list_(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]

    return pa.schema([pa.field(n, kind(t)) for n, t in (f.split(None, 1) for f in _fields(schema))])


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a simple DDL string."""
    return _arrow_schema(schema)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tiermeter-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    This cuts the lineage: a lost executor costs no more than the tasks that
    follow the table. The table goes when the driver ends, or by ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not MADE:
        atexit.register(drop_tables, spark)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the written tables that are still there.
MADE: list[str] = []


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the written tables but the first ``since`` and the last ``keep``; only what is read no more may go."""
    gone = MADE[since : len(MADE) - keep]
    for path in gone:
        remove(spark, path)
        MADE.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; quiet where the session has ended already."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        return
