"""Finding which of many prompts a text contains, by an automaton over all of them.

Prompts up to ``SHARD_CHARS`` characters in all are broadcast, and every request
streams through one automaton in Arrow batches, without a shuffle of texts. More
prompts are cut into shards of that size; then each request goes to every shard,
in as many parts as the requests' size asks for, and the shards' finds are merged.
A request gives one row for each shard at most, however many places match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermeter.sources.tables import kept

#: Characters of the prompts of one automaton (some hundred bytes of memory for each).
SHARD_CHARS = 1 << 21
#: Characters of requests that one task takes through a shard.
PART_CHARS = 1 << 28

#: The automaton that this worker used last, by the name of its prompts.
_LAST: dict[str, ahocorasick.Automaton] = {}


def automaton(prompts: Iterable[str]) -> ahocorasick.Automaton:
    """Matches prompts; a match gives the prompt's length and place in ``prompts``."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(prompts):
        out.add_word(p, (len(p), k))
    out.make_automaton()
    return out


def longest_in(machine: ahocorasick.Automaton, text: str | None) -> int | None:
    """The place of the longest prompt that ``text`` contains; of equally long ones the last."""
    found = max((m for _, m in machine.iter(text)), default=None) if text and len(machine) else None
    return None if found is None else found[1]


def _finds(machine: ahocorasick.Automaton, batch: pa.RecordBatch, ids: pa.Array, lengths: pa.Array, out: pa.Schema) -> pa.RecordBatch:
    at = [(i, k) for i, text in enumerate(batch.column("request").to_pylist()) if (k := longest_in(machine, text)) is not None]
    rows, places = (pa.array(c, pa.int64()) for c in (zip(*at, strict=True) if at else ((), ())))
    return pa.RecordBatch.from_arrays([batch.column("request_id").take(rows), lengths.take(places).cast(pa.int32()), ids.take(places)], schema=out)


def longest_contained(requests: DataFrame, tasks: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``request_id`` and ``task_id``: for each request the task with the longest prompt that the request contains.

    Of equally long prompts (or one prompt of several tasks) the highest task id
    counts. Requests without a match give no row; null and empty prompts match
    nothing. Rows that share a ``request_id`` are one request of several texts.
    """
    prompts = tasks.where(F.length("prompt") > 0).groupBy("prompt").agg(F.max("task_id").alias("task_id"))
    prompts = kept(prompts.select("prompt", "task_id", F.length("prompt").alias("chars")), "prompts")
    total = prompts.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    asked = requests.select("request_id", "request")
    schema = T.StructType([asked.schema["request_id"], T.StructField("chars", T.IntegerType()), prompts.schema["task_id"]])
    if total <= shard_chars:
        found = asked.mapInArrow(_through_one(prompts), schema)
    else:
        found = _through_shards(asked, prompts, -(-total // shard_chars), schema)
    return found.groupBy("request_id").agg(F.max_by("task_id", F.struct("chars", "task_id")).alias("task_id"))


def _through_one(prompts: DataFrame) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All prompts (at most ``SHARD_CHARS`` characters) sent to every worker, which builds the automaton once."""
    table = prompts.orderBy("task_id").toArrow()
    name = uuid.uuid4().hex
    sent = prompts.sparkSession.sparkContext.broadcast((table.column("prompt").to_pylist(), table.column("task_id").combine_chunks(), table.column("chars").combine_chunks()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, lengths = sent.value
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = automaton(words)
        for batch in batches:
            out = pa.schema([batch.schema.field("request_id"), ("chars", pa.int32()), ("task_id", ids.type)])
            yield _finds(_LAST[name], batch, ids, lengths, out)

    return run


def _through_shards(asked: DataFrame, prompts: DataFrame, shards: int, schema: T.StructType) -> DataFrame:
    """Prompts and requests meet by (shard, part); a shard's prompts come first, then its requests stream by."""
    size = asked.agg(F.coalesce(F.sum(F.length("request").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_CHARS), asked.sparkSession.sparkContext.defaultParallelism // shards)
    shard = F.pmod(F.xxhash64("prompt"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64("request_id", "request"), F.lit(parts)).cast("int")
    nothing = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    words = prompts.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "prompt", "task_id", "chars", nothing(asked, "request_id"), nothing(asked, "request"))
    texts = asked.where("request is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part.alias("part"), nothing(prompts, "prompt"), nothing(prompts, "task_id"), nothing(prompts, "chars"), "request_id", "request")
    both = words.union(texts).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("prompt").isNull(), "task_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, machine = None, [], None
        ids = lengths = None
        for whole in batches:
            key = list(zip(whole.column("shard").to_pylist(), whole.column("part").to_pylist(), whole.column("prompt").is_null().to_pylist(), strict=True))
            first = 0
            for i in range(1, len(key) + 1):
                if i < len(key) and key[i] == key[first]:
                    continue
                batch, (s, p, request) = whole.slice(first, i - first), key[first]
                first = i
                if (s, p) != at:
                    at, table, machine = (s, p), [], None
                if not request:
                    table.append(batch)
                    continue
                if not table:  # a shard without prompts
                    continue
                if machine is None:
                    mine = pa.Table.from_batches(table)
                    machine, ids, lengths = automaton(mine.column("prompt").to_pylist()), mine.column("task_id").combine_chunks(), mine.column("chars").combine_chunks()
                out = pa.schema([batch.schema.field("request_id"), ("chars", pa.int32()), ("task_id", ids.type)])
                yield _finds(machine, batch, ids, lengths, out)

    return both.mapInArrow(run, schema)
