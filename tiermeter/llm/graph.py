"""Connected components of an edge table: contraction rounds, then one bounded task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, tidied, written

#: Edges that one task solves by itself; more are contracted by shuffling first.
TASK_EDGES = 1 << 20
LABELS = "node long, root long"


#: Parts of all rows above which a key is hot; there can be no more hot keys than that.
HOT_KEYS = 4096


def hot_join(rows: DataFrame, one: DataFrame, key: str | list[str], count: str, total: int, how: str) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) by ``key`` with ``one``, a written table that has a row for each key.

    ``count`` is how many of the ``total`` rows have the key. Keys with more than
    a ``HOT_KEYS``-th of the rows are at most ``HOT_KEYS``; they are broadcast,
    so none of them fills a task. The others are joined as usual.
    """
    hot = F.col(count) > max(total // HOT_KEYS, 1)
    few = F.broadcast(one.where(hot))
    many = rows.join(few, key, "inner")
    rest = rows.join(few.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(one.where(~hot), key, how)
    return many.union(rest)


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the lowest node of each one's component."""
    node, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(node))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        # what a node learned goes to its old label too, and labels are followed
        np.minimum.at(low, label, low)
        low = low[low]
        if np.array_equal(low, label):
            return node, node[label]
        label = low


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=arrow_schema(LABELS))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the lowest node of its component) for the nodes of ``u``-``v`` edges.

    While there are more than ``TASK_EDGES`` edges, every node moves to the
    neighbour of lowest hash, if that is below its own, and the edges are
    rewritten; long chains of rising ids thus shrink as fast as any graph. What
    is left is solved in one task. Tables of each round are written to the
    shared folder. Loops and repeated edges do no harm.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    moves: list[DataFrame] = []
    while (n_edges := edges.count()) > TASK_EDGES:
        salt = F.lit(len(moves))
        both = edges.union(edges.select("v", "u"))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v").alias("to"))).alias("b"), F.count("*").alias("degree"))
        own = F.xxhash64("u", salt)
        move = written(best.select(F.col("u").alias("node"), F.when(F.col("b.h") < own, F.col("b.to")).otherwise(F.col("u")).alias("to"), "degree"), "moves")
        moves.append(move)
        left = hot_join(edges, move.select(F.col("node").alias("u"), F.col("to").alias("x"), "degree"), "u", "degree", n_edges, "inner").drop("degree")
        full = hot_join(left, move.select(F.col("node").alias("v"), F.col("to").alias("y"), "degree"), "v", "degree", n_edges, "inner")
        edges = written(full.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    labels = written(edges.coalesce(1).mapInArrow(tidied(_solve), LABELS), "labels")  # TASK_EDGES edges at most
    if not moves:
        return labels
    for move in reversed(moves):
        after = labels.select(F.col("node").alias("to"), "root")
        labels = move.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    labels = written(labels, "labels")
    lowest = labels.groupBy("root").agg(F.min("node").alias("lowest"))
    return labels.join(lowest, "root").select("node", F.col("lowest").alias("root"))
