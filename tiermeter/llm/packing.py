"""Hierarchical packing of documents into several context sizes (op 3).

Each partition packs its own documents in blocks of bounded size, so nothing is
shuffled. A block goes through four steps:

1. route: a document longer than the longest context gives whole windows first;
   the rest goes to the smallest tier that holds it;
2. pack each tier, longest first, by best fit decreasing;
3. fill what is free in long windows from the shorter tiers, with whole
   documents while they fit and then with the head of one that is cut;
4. deal the full windows of a tier to step groups of equal token counts, so
   that the groups' attention costs come out nearly even.

What isn't full at the end of a block is carried to the next block. At the end of
a partition the rest fills windows of ever shorter tiers; at most one window a
partition is not full.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, tidied, with_bytes
from tiermeter.llm.tokens import encoded, tokenizer_path

#: Context sizes, ascending powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens of a block, and of a step group.
BLOCK_TOKENS, GROUP_TOKENS = 1 << 20, 1 << 14
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

#: A piece: its document's number, its start and its length.
Piece = tuple[int, int, int]


class Pool:
    """Pieces by length, for taking the longest that fits or the shortest that doesn't."""

    def __init__(self, pieces: Iterable[Piece] = ()):
        self.items = sorted((n, d, s) for d, s, n in pieces)
        self.tokens = sum(x[0] for x in self.items)

    def put(self, piece: Piece) -> None:
        insort(self.items, (piece[2], piece[0], piece[1]))
        self.tokens += piece[2]

    def _take(self, at: int) -> Piece:
        n, d, s = self.items.pop(at)
        self.tokens -= n
        return d, s, n

    def longest(self, most: int) -> Piece | None:
        at = bisect_right(self.items, (most, float("inf"), 0))
        return self._take(at - 1) if at else None

    def over(self, size: int) -> Piece | None:
        at = bisect_left(self.items, (size, -1, -1))
        return self._take(at) if at < len(self.items) else None


def pack_tiers(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (tier, pieces), and the pieces that are left.

    With ``last`` nothing is left: a rest fills shorter tiers, and at most one
    window is not full.
    """
    top = tiers[-1]
    full: list[tuple[int, list[Piece]]] = []
    routed: dict[int, list[Piece]] = {t: [] for t in tiers}
    for d, s, n in pieces:
        while n >= top:
            full.append((top, [(d, s, top)]))
            s, n = s + top, n - top
        if n:
            routed[tiers[bisect_left(tiers, n)]].append((d, s, n))
    pools = {t: Pool(routed[t]) for t in tiers}
    for tier in reversed(tiers):
        below = [t for t in reversed(tiers) if t < tier]
        own = pools[tier]
        while own.items:
            free, window = tier, []
            while free:
                piece = next((p for t in (tier, *below) if (p := pools[t].longest(free))), None)
                if piece is None:  # nothing whole fits: the head of the shortest longer piece
                    over = next((p for t in (*reversed(below), tier) if (p := pools[t].over(free))), None)
                    if over is None:
                        break
                    d, s, n = over
                    piece = (d, s, free)
                    pools[tiers[bisect_left(tiers, n - free)]].put((d, s + free, n - free))
                window.append(piece)
                free -= piece[2]
            if free:  # all pools that could fill it are empty
                for p in window:
                    pools[tiers[bisect_left(tiers, p[2])]].put(p)
                break
            full.append((tier, window))
    rest = [(d, s, n) for t in tiers for n, d, s in pools[t].items]
    if not last or not rest:
        return full, rest
    for tier in reversed(tiers):
        while sum(p[2] for p in rest) >= tier:
            window, free = [], tier
            while free:
                d, s, n = rest.pop()
                take = min(n, free)
                window.append((d, s, take))
                free -= take
                if n > take:
                    rest.append((d, s + take, n - take))
            full.append((tier, window))
    if rest:
        full.append((tiers[bisect_left(tiers, sum(p[2] for p in rest))], rest))
    return full, []


def step_groups(windows: list[tuple[int, list[Piece]]], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """A group number for each window; groups of a tier have equal token counts.

    Windows are dealt in order of attention cost (sum of squared piece lengths),
    back and forth over the groups.
    """
    out = [0] * len(windows)
    first = 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
        groups = -(-len(own) * tier // group_tokens)
        for k, i in enumerate(own):
            turn, place = divmod(k, groups)
            out[i] = first + (place if turn % 2 == 0 else groups - 1 - place)
        first += groups
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack all documents; one row for each piece, with its token ids.

    A null or empty text is the end id alone. A null ``doc_id`` stays null.
    Repeated rows are packed one by one, each with all its ids. An empty table
    gives no rows. A text of any length is cut without loss.
    """
    path = path or tokenizer_path()
    target = arrow_schema(SCHEMA)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        n_seq = n_groups = 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        pieces: list[Piece] = []
        held = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal n_seq, n_groups, doc_ids, ids, pieces, held
            windows, rest = pack_tiers(pieces, tiers, last)
            groups = step_groups(windows, group_tokens)
            columns: list[list] = [[] for _ in target]
            for (tier, window), group in zip(windows, groups, strict=True):
                offset = 0
                for d, s, n in window:
                    for column, v in zip(columns, (doc_ids[d], s, n, ids[d][4 * s : 4 * (s + n)], len(ids[d]) // 4, base + n_seq, offset, tier, base + n_groups + group), strict=True):
                        column.append(v)
                    offset += n
                n_seq += 1
            n_groups += max(groups, default=-1) + 1
            keep = sorted({p[0] for p in rest})
            new = {d: k for k, d in enumerate(keep)}
            doc_ids, ids = [doc_ids[d] for d in keep], [ids[d] for d in keep]
            pieces = [(new[d], s, n) for d, s, n in rest]
            held = sum(p[2] for p in pieces)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for names, found in encoded(batches, path):
            for doc_id, text_ids in zip(names, found, strict=True):
                doc_ids.append(doc_id)
                ids.append(text_ids.tobytes() + end)
                pieces.append((len(ids) - 1, 0, len(ids[-1]) // 4))
                held += pieces[-1][2]
                if held >= block_tokens:
                    yield close(False)
        yield close(True)

    return with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run, "tokens"), SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces without their ids, which become a CRC-32."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
