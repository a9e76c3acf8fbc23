"""N-gram Jaccard similarity join by MinHash banding (op 2).

1. Texts with the same words are one text with so many copies.
2. Each distinct text gets MinHash values, cut into bands; texts that agree in a
   whole band meet in a bucket. A bucket gives one edge from its lowest text to
   each other one, never its pairs.
3. Connected components of these edges bring together all texts that may be
   alike. A component is verified as a whole, or bucket by bucket where its
   buckets hold fewer pairs than it does, so that a long chain of chance meetings
   costs what its buckets cost. Either is dealt to blocks of bounded size, and
   each pair of blocks is verified by itself: all pairs in it, on full n-gram
   sets, by products of sparse columns. A pair that meets in several buckets
   counts in its first. A task returns a row for each text, not for each pair.
4. The verified links give the classes, again as connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_map, arrow_schema, tidied, with_bytes, written
from tiermeter.llm.graph import components, hot_join
from tiermeter.llm.kernels import Batch, mix, windows

SIZE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: Texts and n-grams of a block.
BLOCK_TEXTS, BLOCK_GRAMS = 512, 1 << 21
#: Bits of the filter that spares other documents' texts the way to verification (8 MB at most).
FILTER_BITS = 1 << 26
_CHUNK = 4096


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The longest bands that still find a pair at the threshold with the target recall.

    ``most`` hashes are enough unless even bands of one row need more; then these are used.
    """
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-hit))) if hit < 1 else 1
        if bands * rows <= most or rows == 1:
            return bands, rows
    raise AssertionError("a single row always does")


def gram_batch(texts: list[bytes], size: int) -> tuple[Batch, np.ndarray, np.ndarray]:
    """The batch, its n-gram hashes, and each n-gram's text.

    Words are compared in lower case (A to Z). A text of fewer words than
    ``size`` has one n-gram of all its words.
    """
    b = Batch(texts, lower=True)
    words = b.words()
    grams, at = windows(words, b.doc, size)
    doc = b.doc[at]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < size))
    if len(short):
        last = np.cumsum(b.n_words)
        own = [int(mix(np.bitwise_xor.reduce(mix(words[last[d] - b.n_words[d] : last[d]] + np.arange(b.n_words[d], dtype=np.uint64)), keepdims=True))[0]) for d in short]
        grams, doc = np.append(grams, np.array(own, dtype=np.uint64)), np.append(doc, short)
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    b.word_hashes = words
    return b, grams, doc


def _keys(b: Batch) -> list[bytes | None]:
    last = np.cumsum(b.n_words)
    return [blake2b(b.word_hashes[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(last.tolist(), b.n_words.tolist(), strict=True)]


def band_hashes(grams: np.ndarray, doc: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes; rows of texts without n-grams are meaningless."""
    out = np.zeros((n, bands), dtype=np.uint64)
    if not len(grams):
        return out
    with_grams, first = np.unique(doc, return_index=True)
    rng = np.random.default_rng(31)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    scratch = np.empty_like(grams)
    for k in range(bands):
        value = np.full(len(with_grams), k + 1, dtype=np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            np.bitwise_xor(grams, flip[j], out=scratch)
            np.multiply(scratch, odd[j], out=scratch)
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(scratch, first))
        out[with_grams, k] = value
    return out


def linked(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs (of one list, or across two) have a Jaccard similarity of ``threshold`` or more."""
    n = len(sets)
    both = sets if other is None else sets + other
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    width = int(shared.sum())
    common = np.zeros((n, len(both) - (n if other is not None else 0)), dtype=np.float32)
    edges = np.searchsorted(column, np.arange(0, width + _CHUNK, _CHUNK))
    for k in range(0, width, _CHUNK):
        a, z = edges[k // _CHUNK], edges[k // _CHUNK + 1]
        dense = np.zeros((len(both), min(_CHUNK, width - k)), dtype=np.float32)
        dense[owner[a:z], column[a:z] - k] = 1
        common += dense[:n] @ (dense if other is None else dense[n:]).T
    size = np.array([len(s) for s in both], dtype=np.float64)
    union = size[:n, None] + (size if other is None else size[n:])[None, :] - common
    out = common >= threshold * union - 1e-9
    if other is None:
        np.fill_diagonal(out, False)
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The lowest index that each row reaches by links."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link))
        lower = np.minimum(label, near)
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower


VERIFIED = "node long, links long, u long, v long"
Row = tuple[int, int, int, bytes, bytes]  # node, copies, side, n-grams, bands


def _met_before(left: list[Row], right: list[Row], band: int) -> np.ndarray:
    """Which pairs agree in a band below ``band``."""
    a, b = (np.stack([np.frombuffer(r[4], dtype=np.int64)[:band] for r in side]) if side else np.zeros((0, band), dtype=np.int64) for side in (left, right))
    out = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(band):
        out |= a[:, k, None] == b[None, :, k]
    return out


def _verify(threshold: float):
    target = arrow_schema(VERIFIED)

    def group(rows: list[Row], band: int) -> tuple[list, ...]:
        """One pair of blocks, of a bucket of ``band`` or (-1) of a component."""
        rows.sort(key=lambda r: r[0])
        sides = [[r for r in rows if r[2] == s] for s in (0, 1)]
        sets = [[np.frombuffer(r[3], dtype=np.uint64) for r in side] for side in sides]
        if not sides[0]:
            return [], [], [], []
        one = not sides[1]
        link = linked(sets[0], None if one else sets[1], threshold)
        if band > 0:
            link &= ~_met_before(sides[0], sides[0] if one else sides[1], band)
        n = len(sides[0])
        copies = [np.array([r[1] for r in side]) for side in sides]
        if one:
            counts, square, members = link @ copies[0], link, sides[0]
        else:
            counts = np.concatenate((link @ copies[1], link.T @ copies[0]))
            square = np.zeros((len(rows), len(rows)), dtype=bool)
            square[:n, n:], square[n:, :n] = link, link.T
            members = sides[0] + sides[1]
        root, hit = _roots(square), np.flatnonzero(counts)
        return [members[k][0] for k in hit], counts[hit].tolist(), [members[k][0] for k in hit], [members[root[k]][0] for k in hit]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        rows: list[Row] = []
        now = None

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)
            for c in out:
                c.clear()
            return batch

        def close() -> None:
            if rows:
                for column, values in zip(out, group(rows, now[1]), strict=True):
                    column.extend(values)
                rows.clear()

        for batch in batches:
            c = batch.to_pydict()
            for at, row in zip(zip(c["unit"], c["band"], c["low"], c["high"], strict=True), zip(c["node"], c["copies"], c["side"], c["grams"], c["bands"], strict=True), strict=True):
                if at != now:
                    close()
                    if len(out[0]) > 20_000:
                        yield flush()
                now = at
                rows.append(row)
        close()
        yield flush()

    return run


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``bits`` bits with the ids' hashes; its size doesn't depend on the data."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``key`` (of the words, null without any), ``raw`` (of the text) and ``bands`` of every row; written."""

    def sign(c: dict[str, list]) -> dict[str, object]:
        b, grams, doc = gram_batch(c["text"], size)
        hashes = band_hashes(grams, doc, b.n, bands, rows).view(np.int64)
        return {"doc_id": c["doc_id"], "raw": c["raw"], "key": _keys(b), "bands": [h.tobytes() for h in hashes]}

    source = with_bytes(docs.withColumn("raw", _raw()), "doc_id", "raw").withColumn("doc_id", F.col("doc_id").cast("long"))
    return written(arrow_map(source, sign, "doc_id long, raw long, key binary, bands binary"), "signatures")


def _raw() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _units(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """(``unit``, ``band``, ``node``): what is verified together; ``band`` is -1 for a whole component.

    A component is split to its buckets where these hold fewer pairs than it,
    unless it fits a block. ``members`` has the texts of each bucket (``bucket``, ``band``, ``node``, ``n``).
    """
    sizes = candidates.groupBy("component").agg(F.count("*").alias("texts"))
    in_buckets = members.join(candidates.select("node", "component"), "node")
    pairs = in_buckets.groupBy("component").agg(F.sum("n").alias("pairs"))  # over the texts of a bucket: its square
    whole = sizes.join(pairs, "component").select("component", (F.col("texts") * F.col("texts") <= F.greatest("pairs", F.lit(BLOCK_TEXTS**2))).alias("whole"))
    split = written(whole.where("not whole").select("component"), "split")
    if split.isEmpty():
        return candidates.select(F.col("component").alias("unit"), F.lit(-1).alias("band"), "node")
    as_one = candidates.join(split, "component", "left_anti").select(F.col("component").alias("unit"), F.lit(-1).alias("band"), "node")
    return as_one.union(in_buckets.join(split, "component").select(F.col("bucket").alias("unit"), "band", "node"))


def _classes(docs: DataFrame, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures, and for each distinct text ``key``, ``rep`` (its lowest id), ``raw`` (of a row of that id), ``copies``, ``links``, ``class_id`` and ``first`` (of its class)."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = _signatures(docs, size, bands, rows)
    known = signed.where("doc_id is not null and key is not null")
    texts = known.groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("f"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # The number is stored with the table, so it stays the same for whoever reads it.
    texts = written(texts.select(F.monotonically_increasing_id().alias("node"), "key", F.col("f.doc_id").alias("rep"), F.col("f.raw").alias("raw"), "copies", "bands"), "texts")

    listed = arrow_map(texts.select("node", F.col("bands").alias("text")), lambda c: {"node": c["node"], "buckets": [np.frombuffer(b, dtype=np.int64) for b in c["text"]]}, "node long, buckets array<long>")
    in_buckets = listed.select("node", F.posexplode("buckets").alias("band", "bucket"))
    buckets = written(in_buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(hot_join(in_buckets, buckets, "bucket", "n", texts.count() * bands, "inner"), "members")
    near = components(members.select(F.col("low").alias("u"), F.col("node").alias("v")))
    candidates = written(texts.drop("raw").join(near.select("node", F.col("root").alias("component")), "node"), "candidates")

    bitmap = id_filter(candidates.select(F.col("rep").alias("id")))
    session = docs.sparkSession.sparkContext.broadcast(bitmap)  # FILTER_BITS / 8 bytes
    source = with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    placed = source.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))

    def gather(c: dict[str, list]) -> dict[str, object]:
        place = np.array(c["place"], dtype=np.int64)
        hit = np.flatnonzero((session.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).tolist()
        b, grams, doc = gram_batch([c["text"][k] for k in hit], size)
        cuts = np.searchsorted(doc, np.arange(b.n + 1))
        sets = [np.unique(grams[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"rep": [c["doc_id"][k] for k in hit], "key": _keys(b), "n_grams": [len(s) for s in sets], "grams": [s.tobytes() for s in sets]}

    sets = arrow_map(placed, gather, "rep long, key binary, n_grams long, grams binary").where("key is not null")
    sets = written(sets.join(candidates.select("rep", "key", "node", "copies", "bands"), ["rep", "key"]).dropDuplicates(["node"]).drop("rep", "key"), "gram-sets")
    # Units are dealt without the n-grams, which join them for the one shuffle to their blocks.
    parts = written(_units(candidates, members).join(sets.select("node", "n_grams"), "node"), "units")
    blocks = parts.groupBy("unit", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("texts"))
    dealt = hot_join(parts, written(blocks, "blocks"), ["unit", "band"], "texts", parts.count(), "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("unit", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", (F.col("block") > F.col("other")).cast("int").alias("side"))
    keyed = dealt.join(sets.select("node", "copies", "grams", "bands"), "node").repartition("unit", "band", "low", "high").sortWithinPartitions("unit", "band", "low", "high")
    verified = written(keyed.mapInArrow(tidied(_verify(threshold)), VERIFIED), "verified")

    roots = components(verified.select("u", "v")).select("node", "root")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked_texts = texts.select("node", "key", "rep").join(roots, "node")
    lowest = linked_texts.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("l"))
    of_class = linked_texts.join(lowest, "root").join(links, "node", "left").select("node", "links", F.col("l.rep").alias("class_id"), (F.col("l.key") == F.col("key")).alias("first"))
    of_text = texts.select("node", "key", "rep", "raw", "copies").join(of_class, "node", "left")
    of_text = of_text.select("key", "rep", "raw", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return signed, written(of_text, "classes")


def similar(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``copy_of`` for every row.

    Two rows are linked if the Jaccard similarity of their sets of n-grams of
    ``size`` words is ``threshold`` or more; ``class_id`` is the lowest id that
    can be reached by links, ``n_links`` the number of other rows linked to this
    one, ``copy_of`` the lowest id with the same words. Rows that share an id
    are linked by their texts alone, so unlike texts of one id may have
    different classes.

    A null or empty text, or one of white space, is linked to nothing and is its
    own class. A null ``doc_id`` has a null class and no links.
    """
    signed, of_text = _classes(docs, size, threshold, recall)
    found = of_text.select("key", F.col("rep").alias("copy_of"), "class_id", "copies", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    joined = hot_join(rows, found, "key", "copies", signed.count(), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def one_of_each(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class; all columns of ``docs``.

    It is a row of the class's lowest id; where that id has several texts of the
    class, one of the text whose key is lowest. Rows without words or with a
    null id all stay, as nothing is linked to them.
    """
    _, of_text = _classes(docs, size, threshold, recall)
    kept = written(of_text.where("first").select(F.col("rep").alias("__kept_id"), F.col("raw").alias("__kept_raw")), "kept")
    cast = F.col("doc_id").cast("long")
    odd = cast.isNull() | ~F.coalesce(F.col("text").cast("string").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.where(~odd).withColumn("__raw", _raw())
    chosen = rows.join(kept, (cast == F.col("__kept_id")) & (F.col("__raw") == F.col("__kept_raw"))).dropDuplicates(["__kept_id", "__kept_raw"]).drop("__kept_id", "__kept_raw", "__raw")
    return chosen.unionByName(docs.where(odd))
