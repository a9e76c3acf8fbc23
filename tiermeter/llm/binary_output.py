"""Packed token-id matrices by best fit decreasing (op 8).

Each partition packs its documents in blocks. Within a block the pieces are
placed longest first into the open row with the least room that still holds
them; a segment tree over the room left (0 to the row's size) finds that row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, tidied, with_bytes
from tiermeter.llm.tokens import encoded, tokenizer_path

ROW, BLOCK_TOKENS = 2048, 1 << 20
SCHEMA = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class Room:
    """Open rows by room left, with a segment tree of how many rows have it."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room that is at least ``need``, and that room."""
        at, count = need + self.width, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.width
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], size: int = ROW) -> list[list[int]]:
    """Rows of piece numbers; each row's lengths add up to ``size`` at most."""
    room, rows = Room(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = room.take(n)
        if found is None:
            rows.append([i])
            row, free = len(rows) - 1, size
        else:
            row, free = found
            rows[row].append(i)
        if free > n:
            room.add(free - n, row)
    return rows


def write_rows(docs: DataFrame, path: str | None = None, size: int = ROW, end_id: int = 1, pad_id: int = 0, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each packed sequence.

    ``ids``: a row of the matrix, ``size`` little-endian unsigned ids of
    ``id_bytes`` bytes, padded with ``pad_id``; ``cu_seqlens``: cumulative
    lengths of its pieces, from 0; ``position_resets``: where positions start
    from 0 again; ``doc_ids`` and ``doc_starts``: each piece's document, and its
    ids before the piece. A document longer than a row is split without loss.

    A null or empty text is the end id alone; null ids stay null in ``doc_ids``;
    repeated rows are all packed; an empty table gives no rows.
    """
    path = path or tokenizer_path()
    target = arrow_schema(SCHEMA)
    kind = f"<u{id_bytes}"

    def block(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> pa.RecordBatch:
        pieces = [(d, s, min(size, len(x) - s)) for d, x in enumerate(ids) for s in range(0, len(x), size)]
        out: list[list] = [[] for _ in target]
        for k, row in enumerate(best_fit_decreasing([p[2] for p in pieces], size)):
            line = np.full(size, pad_id, dtype=kind)
            ends = [0]
            for d, s, n in (pieces[i] for i in row):
                line[ends[-1] : ends[-1] + n] = ids[d][s : s + n]
                ends.append(ends[-1] + n)
            values = (first + k, line.tobytes(), ends[-1], ends, ends[:-1], [doc_ids[pieces[i][0]] for i in row], [pieces[i][1] for i in row])
            for column, v in zip(out, values, strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0
        for names, found in encoded(batches, path):
            for doc_id, text_ids in zip(names, found, strict=True):
                own = np.append(text_ids, np.uint32(end_id))
                if id_bytes < 4 and own.max() >= 1 << 8 * id_bytes:
                    raise ValueError(f"an id needs more than {id_bytes} bytes")
                doc_ids.append(doc_id)
                ids.append(own.astype(kind))
                held += len(own)
                if held >= block_tokens:
                    yield (done := block(doc_ids, ids, first))
                    first, doc_ids, ids, held = first + done.num_rows, [], [], 0
        if ids:
            yield block(doc_ids, ids, first)

    return with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run, "tokens"), SCHEMA)
