"""A hashed maximum-entropy language model (op 7).

A word's probability is factored: P(class | context) from a softmax over the
classes, then P(word | class, context) from a softmax over the frequent words of
the class and one place for its rest, which the rest share by their smoothed
counts. The context gives n-gram and skip features: each of the last three words,
and the hashed pair of the last two; for the words of a class the last word and the
pair are hashed together with the class. A context word stands for itself if it is frequent, else
for its form, a bucket of its ending, length and punctuation. Classes are
clusters of forms that stand in like places, found from counts of neighbouring
forms.

1. Counts of all training words, and of pairs of forms, added up by shuffling.
   They size the table of pairs and tell the frequent words.
2. Weights start from the counts. In each of ``TURNS`` synchronous rounds every
   partition takes gradient steps over its documents of the round, and each
   feature's change is averaged over the partitions by how often they met it.
   As steps are local within a round, another partitioning gives slightly other
   weights.
3. Words without a place of their own share their class's rest by exact counts of
   what they follow: with c of a context and a word, q the word's smoothed share of
   the rest, and the context's tokens and kinds of words in that rest,
   P(word | rest, context) = (max(c - 1, 0) + kinds * q) / tokens. The context is the
   last word, whatever its count, by one of ``CONTEXTS`` hashes. All pairs are counted,
   dealt by the word.
4. Scoring takes counts of at most ``TOP_WORDS`` words, those above a count, from
   a broadcast of bounded size; rarer words are joined to the count table. Tokens in
   a rest are dealt to the pairs by their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, sliced, tidied, with_bytes, written
from tiermeter.llm.kernels import Batch, mix
from tiermeter.llm.labelled import held_out

SMOOTH = 0.1
FORMS, CLASSES = 512, 24
#: Places in a class: its rest, and its most frequent words.
PLACES = 16
#: Frequent words, at most; a word among them has at least this share of all tokens.
FREQUENT, SHARE = 1024, 2.0**-14
#: Tokens for each row of the table of pairs, and the least and most rows.
PAIR_TOKENS, PAIR_ROWS = 256, (1 << 12, 1 << 14)
PLACE_ROWS = 1 << 14
EDGE = FORMS - 1  # the end of a text, and what stands before its start
END_WORD = np.uint64(0x454E44)
TOP_WORDS = 1 << 19
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 1 << 19
STEP_TOKENS, RATE, TURNS = 1 << 15, 0.08, 3
CHUNK_ROWS = 256
#: Hashes of the last word, before words in a rest; they have 16 bits.
CONTEXTS = 1 << 16
#: Chunks of the table of contexts and classes.
CELL_CHUNKS = 64
#: Tokens in a rest that a task holds before it deals them, and training tokens for each part they are dealt to.
DEALT_TOKENS, PART_TOKENS = 1 << 20, 1 << 21


def forms(b: Batch, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The buckets of all words, or of those ``at``: by the last three bytes, the length and the last sign."""
    first, stop = b.start[at], b.end[at]
    last = b.buf[stop - 1]
    sign = (last < 48) | ((last > 57) & (last < 97)) | ((last > 122) & (last < 128))
    sign &= stop - first > 1
    end = stop - sign
    length = end - first
    value = b.buf[end - 1].astype(np.uint64)
    for k in (2, 3):
        value = value << np.uint64(8) | np.where(length >= k, b.buf[np.maximum(end - k, 0)], 0).astype(np.uint64)
    value = value << np.uint64(4) | (np.minimum(length // 3, 3) * 2).astype(np.uint64) | sign.astype(np.uint64)
    return (mix(value) % np.uint64(EDGE)).astype(np.int64)


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, a place of each, and the number of the word at every place."""
    types, of = np.unique(words, return_inverse=True)
    at = np.empty(len(types), dtype=np.int64)
    at[of] = np.arange(len(of))
    return types, at, of


def sequence(b: Batch, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Units with each text's end put in, the texts' numbers, and the three units before each."""
    total = len(unit) + b.n
    at = np.arange(len(unit)) + b.doc
    line = np.full(total, EDGE, dtype=np.int64)
    line[at] = unit
    doc = np.repeat(np.arange(b.n), b.n_words + 1)
    before = []
    prior = line
    for _ in range(3):
        prior = np.concatenate(([EDGE], prior[:-1]))
        if before:
            prior = np.where(before[-1] == EDGE, EDGE, prior)
        before.append(prior)
    return line, doc, before


def bucket(size: int, key: np.ndarray) -> np.ndarray:
    """A row of a table of ``size`` rows, a power of two."""
    return (mix(key.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) & np.uint64(size - 1)).astype(np.int64)


def pair_row(size: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return bucket(size, one << 16 | two)


def place_rows(group: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Of the last word and of the last two, each with the class."""
    return [bucket(PLACE_ROWS, group << 40 | one << 16), bucket(PLACE_ROWS, group << 40 | one << 16 | two | 1 << 50)]


def logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Of each token's features, less their highest; ``bias`` is one for all or one for each token."""
    z = weights[rows[0]]
    z += bias
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(axis=1, keepdims=True)
    return z


def log_softmax_at(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    z = logits(weights, bias, rows)
    out = z[np.arange(len(z)), target]
    return out - np.log(np.einsum("ij->i", np.exp(z, out=z)))


def gradient_step(weights: np.ndarray, grown: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray, rate: float = RATE) -> None:
    """One step on a run of tokens, with a rate for each weight."""
    error = logits(weights, bias, rows)
    np.exp(error, out=error)
    error /= np.einsum("ij->i", error)[:, None] * np.float32(len(target))
    error[np.arange(len(target)), target] -= np.float32(1 / len(target))
    twos = np.float32 if error.shape[1] % 2 else np.complex64  # two columns to a number halve the calls of reduceat
    for r in rows:
        order = np.argsort(r.astype(np.uint16), kind="stable")
        own = r[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        slope = np.add.reduceat(error[order].view(twos), first, axis=0).view(np.float32)
        at = own[first]
        sums = grown[at]
        sums += slope * slope
        grown[at] = sums
        slope *= np.float32(rate)
        slope /= np.sqrt(sums, out=sums)
        weights[at] -= slope


def cluster(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class for each form, by what stands before and after it; the edge is alone in the last."""
    out = np.zeros(FORMS, dtype=np.int64)
    out[EDGE] = classes - 1
    weight = pairs.sum(axis=0)
    known = np.flatnonzero((weight > 0) & (np.arange(FORMS) != EDGE))
    if not len(known):
        return out
    before = pairs[:, known].T / weight[known, None]
    after = pairs[known] / np.maximum(pairs[known].sum(axis=1, keepdims=True), 1)
    place = np.sqrt(np.hstack((before, after)))
    w = weight[known].astype(float)
    k = min(classes - 1, len(known))
    centres = [place[np.argmax(w)]]
    far = ((place - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        centres.append(place[np.argmax(far * np.sqrt(w))])
        far = np.minimum(far, ((place - centres[-1]) ** 2).sum(axis=1))
    centre = np.array(centres)
    for _ in range(30):
        own = np.argmin((centre**2).sum(axis=1)[None, :] - 2 * place @ centre.T, axis=1)
        for j in range(k):
            if (mine := own == j).any():
                centre[j] = np.average(place[mine], axis=0, weights=w[mine])
    out[known] = own
    return out


@dataclass(frozen=True)
class Model:
    tokens: int  # in training texts, with their ends
    types: int
    unseen: float  # probability of the one unseen word
    class_of: np.ndarray  # of each form
    rest_mass: np.ndarray  # sum of count + SMOOTH over a class's words without a place of their own
    frequent: np.ndarray  # sorted hashes
    place: np.ndarray  # of each frequent word; 0 in the rest
    pairs: int  # rows of the table of pairs
    bias: np.ndarray
    weights: np.ndarray
    place_bias: np.ndarray  # classes x places; minus infinity where there is no word
    place_weights: np.ndarray
    top: np.ndarray  # sorted hashes of the words whose counts are broadcast
    top_count: np.ndarray
    cells: tuple[np.ndarray, np.ndarray] | None = None  # tokens, and kinds of words, in the rest of each class after each context
    after: DataFrame | None = None  # pairs, see ``followers``; stays with the driver

    def read(self, b: Batch) -> Tokens:
        """A batch's tokens: what they are, and their features."""
        # What a word is, is looked up once for each word of the batch.
        types, at, type_of = distinct(b.words())
        form = np.append(forms(b, at), EDGE)
        types = np.append(types, END_WORD)
        at = np.minimum(np.searchsorted(self.frequent, types), max(len(self.frequent) - 1, 0))
        own = self.frequent[at] == types if len(self.frequent) else np.zeros(len(types), dtype=bool)
        unit = np.where(own, FORMS + at, form)
        place = np.where(own, self.place[at], 0) if len(self.frequent) else np.zeros(len(types), dtype=np.int64)
        line, doc, (one, two, three) = sequence(b, unit[type_of])
        of = np.full(len(line), len(types) - 1, dtype=np.int64)
        of[np.arange(len(type_of)) + b.doc] = type_of
        n = FORMS + len(self.frequent)
        group = self.class_of[form][of]
        rows = [one, n + two, 2 * n + three, 3 * n + pair_row(self.pairs, one, two)]
        return Tokens(types, of, doc, group, place[of], rows, place_rows(group, one, two))

    def rest(self, b: Batch) -> Rest:
        """A batch's words in the rest of a class; ends are in none."""
        types, at, type_of = distinct(b.words())
        group = self.class_of[forms(b, at)]
        own = np.zeros(len(types), dtype=bool)
        if len(self.frequent):
            near = np.minimum(np.searchsorted(self.frequent, types), len(self.frequent) - 1)
            own = (self.frequent[near] == types) & (self.place[near] > 0)
        where = np.flatnonzero(~own[type_of])
        prior = np.where(np.diff(b.doc, prepend=-1) > 0, len(types), np.roll(type_of, 1))
        return Rest(types, group, type_of[where], contexts(np.append(types, END_WORD))[prior[where]], b.doc[where])


@dataclass(frozen=True)
class Tokens:
    types: np.ndarray  # hashes of the batch's words, in order, and of the end
    type_of: np.ndarray
    doc: np.ndarray
    group: np.ndarray  # class
    place: np.ndarray
    rows: list[np.ndarray]  # of the table for classes
    place_rows: list[np.ndarray]  # of the table for places

    def rest(self) -> Rest:
        end = len(self.types) - 1
        group = np.zeros(len(self.types), dtype=np.int64)
        group[self.type_of] = self.group
        where = np.flatnonzero((self.place == 0) & (self.type_of != end))
        prior = np.concatenate(([end], self.type_of[:-1]))
        return Rest(self.types, group, self.type_of[where], contexts(self.types)[prior[where]], self.doc[where])

    def runs(self) -> Iterator[slice]:
        for a in range(0, len(self.doc), STEP_TOKENS):
            yield slice(a, a + STEP_TOKENS)


@dataclass(frozen=True)
class Rest:
    types: np.ndarray  # hashes of the batch's words, in order
    group: np.ndarray  # their classes
    type_of: np.ndarray  # of each token in a rest
    context: np.ndarray
    doc: np.ndarray


def contexts(types: np.ndarray) -> np.ndarray:
    """What each word is as the last one; the end stands before a text's first."""
    return (mix(types) >> np.uint64(48)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers by their lowest bytes, then the next ones, compressed; the length stands before."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T if len(values) else values).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def numbers(value: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: ``kind``: 0 for pairs, 1 for tokens to score, 2 for cells; ``part``: of the words, or a chunk of the cells.
DEALT = "kind int, part int, origin long, a binary, b binary, c binary, d binary, e binary"


def dealt(held: list[Rest], firsts: list[int], parts: int, origin: int, count: bool) -> pa.RecordBatch:
    """Tokens as a row for each part of the words: words, their tokens and classes; contexts, and texts less ``origin`` or how often it stands there."""
    types, at, inverse = distinct(np.concatenate([r.types for r in held]))
    group = np.concatenate([r.group for r in held])[at].astype(np.uint8)
    edge = np.cumsum([0] + [len(r.types) for r in held])
    word = np.concatenate([inverse[a:z][r.type_of] for r, a, z in zip(held, edge, edge[1:], strict=False)])
    key = word << 16 | np.concatenate([r.context for r in held])
    if count:
        key, last = np.unique(key, return_counts=True)
    else:
        doc = np.concatenate([r.doc + f for r, f in zip(held, firsts, strict=True)])
        order = np.lexsort((doc, key)) if len(types) >= 1 << 27 or doc.max() >= 1 << 20 else None
        if order is None:  # in one number
            key = np.sort(key << 20 | doc)
            key, last = key >> 20, key & ((1 << 20) - 1)
        else:
            key, last = key[order], doc[order]
    word = key >> 16
    own, first = np.unique(word, return_index=True)
    runs = np.diff(np.append(first, len(word)))
    part = ((types[own] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # grows with the word
    some, start = np.unique(part, return_index=True)
    of_word = [types[own], runs.astype(np.uint32), group[own]]
    of_token = [(key & 0xFFFF).astype(np.uint16), last.astype(np.uint32)]
    stop, first = np.append(start[1:], len(own)), np.append(first, len(word))
    columns = [[packed(v[a:z]) for a, z in zip(start, stop, strict=True)] for v in of_word] + [[packed(v[first[a] : first[z]]) for a, z in zip(start, stop, strict=True)] for v in of_token]
    values = [[int(not count)] * len(some), some, [origin] * len(some), *columns]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow_schema(DEALT), strict=True)], schema=arrow_schema(DEALT))


class Dealer:
    """Holds tokens in a rest and deals them when there are ``most``."""

    def __init__(self, parts: int, most: int, count: bool, row: int = 0):
        self.parts, self.most, self.count, self.origin, self.row, self.size = parts, most, count, row, row, 0
        self.held: list[Rest] = []
        self.firsts: list[int] = []

    def add(self, rest: Rest, n: int) -> Iterator[pa.RecordBatch]:
        """Takes the tokens of the next ``n`` texts."""
        if len(rest.type_of):
            self.held.append(rest)
            self.firsts.append(self.row - self.origin)
            self.size += len(rest.type_of)
        self.row += n
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield dealt(self.held, self.firsts, self.parts, self.origin, self.count)
        self.held, self.firsts, self.origin, self.size = [], [], self.row, 0


def parts_of(tokens: int) -> int:
    return max(16, tokens // PART_TOKENS)


def followers(train: DataFrame, model: Model) -> Model:
    """The model with its cells and pairs.

    A row of the pairs holds, for a part of the words: the words; pairs met twice or
    more, as a word's number and the context; and c - 1 of each, by the word's share.
    """
    given = train.sparkSession.sparkContext.broadcast(replace(model, weights=None, place_weights=None, top=None, top_count=None))
    target = arrow_schema(DEALT)
    parts, most, chunk_cells = parts_of(model.tokens), DEALT_TOKENS, CONTEXTS * CLASSES // CELL_CHUNKS

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        dealer = Dealer(parts, most, True)
        for columns in sliced(batches):
            b = Batch(columns["text"], lower=True)
            yield from dealer.add(m.rest(b), b.n)
        yield from dealer.flush()

    def merged(part: int, rows: list[list[bytes]]) -> pa.RecordBatch:
        m = given.value
        types, at, inverse = distinct(np.concatenate([numbers(r[0], np.uint64) for r in rows]))
        group = np.concatenate([numbers(r[2], np.uint8) for r in rows])[at].astype(np.int64)
        key = np.repeat(inverse, np.concatenate([numbers(r[1], np.uint32) for r in rows])) << 16 | np.concatenate([numbers(r[3], np.uint16) for r in rows])
        key, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([numbers(r[4], np.uint32) for r in rows]))
        word = key >> 16
        share = (np.bincount(word, weights=n) + SMOOTH) / m.rest_mass[group]
        twice = np.flatnonzero(n > 1)
        more = (n[twice] - 1) / share[word[twice]]
        out = [[0, part, None, packed(types), packed(key[twice]), packed(more.astype(np.float32)), None, None]]
        cell = (key & 0xFFFF) * CLASSES + group[word]
        some, inverse = np.unique(cell, return_inverse=True)
        sums = [np.bincount(inverse, weights=n).astype(np.int64), np.bincount(inverse)]
        chunks, start = np.unique(some // chunk_cells, return_index=True)
        for c, a, z in zip(chunks, start, np.append(start[1:], len(some)), strict=True):
            out.append([2, c, None, packed((some[a:z] % chunk_cells).astype(np.int32)), *[packed(v[a:z]) for v in sums], None, None])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for own, *blobs in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7)), strict=True):
                if own != part and rows:
                    yield merged(part, rows)
                    rows = []
                part = own
                rows.append(blobs)
        if rows:
            yield merged(part, rows)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a few of CELL_CHUNKS chunks
        for batch in batches:
            for k, *blobs in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True):
                held, at = sums.setdefault(k, np.zeros((2, chunk_cells), dtype=np.int64)), numbers(blobs[0], np.int32)
                held[0, at] += numbers(blobs[1], np.int64)
                held[1, at] += numbers(blobs[2], np.int64)
        values = [[2] * len(sums), list(sums), [None] * len(sums), *[[packed(v[i].astype(np.float32)) for v in sums.values()] for i in (0, 1)], *[[None] * len(sums)] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

    table = written(train.select("text").mapInArrow(tidied(deal), DEALT).repartition("part").sortWithinPartitions("part").mapInArrow(tidied(merge), DEALT), "pairs")
    cells = np.zeros((2, CELL_CHUNKS, chunk_cells), dtype=np.float32)
    for row in table.where("kind = 2").repartition("part").mapInArrow(tidied(add), DEALT).collect():  # CELL_CHUNKS rows
        cells[:, row.part] = numbers(row.a, np.float32), numbers(row.b, np.float32)
    return replace(model, cells=(cells[0].ravel(), cells[1].ravel()), after=table.where("kind = 0"))


COUNTS = "word long, form int, n long"


def counts(train: DataFrame) -> DataFrame:
    """(``word``, ``form``, ``n``) of all training words and ends; pairs of forms have form -1."""
    target = arrow_schema(COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, form, n = [], [], []
        pairs = np.zeros(FORMS * FORMS, dtype=np.int64)
        held, ends = 0, 0

        def add() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, at, inverse = distinct(np.concatenate(words))
            return w, np.concatenate(form)[at], np.bincount(inverse, weights=np.concatenate(n)).astype(np.int64)

        def rows(w: np.ndarray, f: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(f.astype(np.int32)), pa.array(c)], schema=target)

        for columns in sliced(batches):
            b = Batch(columns["text"], lower=True)
            w, at, inverse = distinct(b.words())
            own = forms(b, at)
            words.append(w)
            form.append(own)
            n.append(np.bincount(inverse, minlength=len(w)))
            held += len(w)
            ends += b.n
            line, _, before = sequence(b, own[inverse])
            pairs += np.bincount(before[0] * FORMS + line, minlength=FORMS * FORMS)
            if held > 2 * HELD_WORDS:
                w, f, c = add()
                words, form, n, held = [w], [f], [c], len(w)
                if held > HELD_WORDS:
                    yield rows(w, f, c)
                    words, form, n, held = [], [], [], 0
        if held:
            yield rows(*add())
        if ends:
            yield rows(np.array([END_WORD]), np.array([EDGE]), np.array([ends]))
            full = np.flatnonzero(pairs)
            yield rows(full.astype(np.uint64), np.full(len(full), -1), pairs[full])

    return train.select("text").mapInArrow(tidied(run), COUNTS).groupBy("word", "form").agg(F.sum("n").alias("n"))


def start(pairs: np.ndarray, class_of: np.ndarray, form_of: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bias: log shares of the classes. Weights of the last word: its form's log ratios to them."""
    by_class = np.zeros((FORMS, CLASSES))
    np.add.at(by_class.T, class_of, pairs.T)
    total = by_class.sum(axis=0) + 0.5
    bias = np.log(total / total.sum())
    smoothed = (by_class + 20 * total / total.sum()) / (by_class.sum(axis=1, keepdims=True) + 20)
    of_form = np.log(smoothed) - bias
    units = FORMS + len(form_of)
    weights = np.zeros((3 * units + n_pairs, CLASSES), dtype=np.float32)
    weights[:FORMS] = of_form
    weights[FORMS:units] = of_form[form_of]
    return weights, bias.astype(np.float32)


CHANGES = "chunk int, met binary, change binary"


def turn(docs: DataFrame, model: Model, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights after gradient steps over ``docs`` in every partition, each row's change averaged by how often it was met."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    target = arrow_schema(CHANGES)
    tables = (model.weights, model.place_weights)
    n_chunks = [-(-len(t) // CHUNK_ROWS) for t in tables]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        first = (m.weights, m.place_weights)
        own = [t.copy() for t in first]
        grown = [np.full(t.shape, 1e-7, dtype=np.float32) for t in first]
        met = [np.zeros(len(t), dtype=np.int64) for t in first]
        several = np.isfinite(m.place_bias[:, 1:]).any(axis=1)
        for columns in sliced(batches):
            t = m.read(Batch(columns["text"], lower=True))
            for k, rows in enumerate((t.rows, t.place_rows)):
                for r in rows:
                    met[k] += np.bincount(r, minlength=len(met[k]))
            for run_ in t.runs():
                gradient_step(own[0], grown[0], m.bias, [r[run_] for r in t.rows], t.group[run_], rate)
                at = np.flatnonzero(several[t.group[run_]]) + run_.start
                if len(at):
                    gradient_step(own[1], grown[1], m.place_bias[t.group[at]], [r[at] for r in t.place_rows], t.place[at], rate)
        chunk, out_met, out_change = [], [], []
        for k, (a, z) in enumerate(zip(first, own, strict=True)):
            for c in range(n_chunks[k]):
                part = slice(c * CHUNK_ROWS, (c + 1) * CHUNK_ROWS)
                if met[k][part].any():
                    chunk.append(c + k * n_chunks[0])
                    out_met.append(met[k][part].tobytes())
                    out_change.append((z[part] - a[part]).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((chunk, out_met, out_change), target, strict=True)], schema=target)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # a few chunks of CHUNK_ROWS rows
        for batch in batches:
            for k, met, change in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = np.frombuffer(met, dtype=np.int64)
                held = sums.setdefault(k, [0, 0.0])
                held[0] = held[0] + n
                held[1] = held[1] + np.frombuffer(change, dtype=np.float16).reshape(len(n), -1).astype(np.float64) * n[:, None]
        rows = [(k, n.tobytes(), (v / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()) for k, (n, v) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    out = [t.copy() for t in tables]
    for row in docs.select("text").mapInArrow(tidied(run), CHANGES).repartition("chunk").mapInArrow(add, CHANGES).collect():  # a row for each chunk of the tables
        k = int(row.chunk >= n_chunks[0])
        part = slice((row.chunk - k * n_chunks[0]) * CHUNK_ROWS, (row.chunk - k * n_chunks[0] + 1) * CHUNK_ROWS)
        out[k][part] += np.frombuffer(row.change, dtype=np.float32).reshape(-1, out[k].shape[1])
    return out[0], out[1]


def least_count(vocabulary: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach: the lowest edge of an eighth of a doubling for which that holds."""
    step = F.floor(F.log2("n") * 8)
    sizes = vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 8 x 63 rows at most
    total, least = 0, (sizes[0]["least"] + 1 if sizes else 1)
    for row in sizes:
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return int(least)


def fit(train_docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model without its pairs, and the table of counts (``word``, ``n``)."""
    table = written(counts(train_docs), "word-counts")
    vocabulary = table.where("form >= 0")
    by_form = vocabulary.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once")).toArrow()
    n, types, once = (by_form.column(c).to_numpy() for c in ("n", "types", "once"))
    pairs = np.zeros(FORMS * FORMS)
    cells = table.where("form = -1").select("word", "n").toArrow()  # FORMS ** 2 rows at most
    pairs[cells.column("word").to_numpy()] = cells.column("n").to_numpy()
    pairs = pairs.reshape(FORMS, FORMS)
    class_of = cluster(pairs)
    mass = np.full(CLASSES, SMOOTH)
    np.add.at(mass, class_of[by_form.column("form").to_numpy()], n + SMOOTH * types)
    tokens = int(n.sum())
    unseen = (once.sum() + 0.5) / (tokens + 1) if tokens else 1.0

    top = vocabulary.where(F.col("n") >= least_count(vocabulary, TOP_WORDS)).select("word", "form", "n").toArrow()  # TOP_WORDS rows at most
    words, form, count = top.column("word").to_numpy().view(np.uint64), top.column("form").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(words)
    words, form, count = words[order], form[order], count[order]
    often = np.flatnonzero((count >= max(SHARE * tokens, 2)) & (words != END_WORD))
    often = np.sort(often[np.lexsort((words[often], -count[often]))[:FREQUENT]])  # in the order of their hashes
    place = np.zeros(len(often), dtype=np.int64)
    place_bias = np.full((CLASSES, PLACES), -np.inf, dtype=np.float32)
    rest_mass = mass.copy()
    for c in range(CLASSES):
        mine = np.flatnonzero(class_of[form[often]] == c)
        mine = mine[np.argsort(-count[often[mine]], kind="stable")][: PLACES - 1]
        place[mine] = np.arange(1, len(mine) + 1)
        own = count[often[mine]] + SMOOTH
        rest_mass[c] -= own.sum()
        place_bias[c, 1 : len(mine) + 1] = np.log(own / mass[c])
        place_bias[c, 0] = np.log(max(rest_mass[c], SMOOTH / 2) / mass[c])
    rest_mass = np.maximum(rest_mass, SMOOTH / 2)
    n_pairs = int(np.clip(1 << int(np.ceil(np.log2(max(tokens // PAIR_TOKENS, 1)))), *PAIR_ROWS))
    weights, bias = start(pairs, class_of, form[often], n_pairs)
    model = Model(tokens, int(types.sum()), float(min(unseen, 1 - 1e-9)), class_of, rest_mass, words[often], place, n_pairs, bias, weights, place_bias, np.zeros((PLACE_ROWS, PLACES), dtype=np.float32), words, count)
    bare = replace(model, top=words[:0], top_count=count[:0])  # without what training doesn't read
    for k in range(TURNS if tokens else 0):
        changed = turn(train_docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == k), bare, RATE / (1 + k))
        bare = replace(bare, weights=changed[0], place_weights=changed[1])
    return replace(model, weights=bare.weights, place_weights=bare.place_weights), vocabulary.select("word", "n")


SCORED = "row long, doc_id long, word long, n long, known long, base double, own double, " + DEALT
SUMS = "origin long, own binary"
ROWS = "row long, own double"


def in_rest(tokens: DataFrame, model: Model) -> DataFrame:
    """(``row``, ``own``): what pairs add to the scores of texts, beyond words' shares of their rests; words never seen have none."""
    n, kinds = model.cells
    with np.errstate(divide="ignore", invalid="ignore"):
        less = np.where(n > 0, np.log10(kinds / n), 0).astype(np.float32)
    given = tokens.sparkSession.sparkContext.broadcast((less, kinds))  # CONTEXTS x CLASSES
    sums_schema, rows_schema = arrow_schema(SUMS), arrow_schema(ROWS)

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less, kinds = given.value
        part = None
        for batch in batches:
            out_origin, out_own = [], []
            for kind, own_part, origin, *blobs in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if kind == 0:
                    part, known = own_part, numbers(blobs[0], np.uint64)
                    pairs, more = numbers(blobs[1], np.int64), numbers(blobs[2], np.float32)
                if kind == 0 or own_part != part:  # no word of this part is known
                    continue
                words = numbers(blobs[0], np.uint64)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                runs = numbers(blobs[1], np.uint32)
                seen, at, group = (np.repeat(v, runs) for v in (known[at] == words, at, numbers(blobs[2], np.uint8)))
                context, doc = numbers(blobs[3], np.uint16).astype(np.int64), numbers(blobs[4], np.uint32)
                cell = context * CLASSES + group
                value = less[cell].astype(np.float64)
                if len(pairs):
                    key = at << 16 | context
                    near = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                    hit = np.flatnonzero((pairs[near] == key) & seen)
                    value[hit] += np.log10(1 + more[near[hit]] / kinds[cell[hit]])
                out_origin.append(origin)
                out_own.append(packed(np.bincount(doc[seen], weights=value[seen]).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(out_origin, pa.int64()), pa.array(out_own, pa.binary())], schema=sums_schema)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, total = None, np.zeros(0)

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(at + origin), pa.array(total[at])], schema=rows_schema)

        for batch in batches:
            for own_origin, own in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if own_origin != origin:
                    if origin is not None:
                        yield rows()
                    origin, total = own_origin, np.zeros(0)
                own = numbers(own, np.float32)
                short, long = sorted((own, total), key=len)
                total = long.astype(np.float64)
                total[: len(short)] += short
        if origin is not None:
            yield rows()

    both = model.after.union(tokens).repartition("part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(tidied(look_up), SUMS).repartition("origin").sortWithinPartitions("origin").mapInArrow(tidied(add), ROWS)


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """Scores for every row; see ``language_model``."""
    given = docs.sparkSession.sparkContext.broadcast(replace(model, cells=None, after=None))  # bounded by TOP_WORDS, FREQUENT and the tables
    target, dealt_fields = arrow_schema(SCORED), arrow_schema(DEALT)
    paired, parts, most = model.after is not None, parts_of(model.tokens), DEALT_TOKENS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        row = TaskContext.get().partitionId() << 40
        log_mass = np.log10(m.rest_mass)
        log_seen = np.log10(1 - m.unseen)
        log_count = np.log10(m.top_count + SMOOTH)
        several = np.isfinite(m.place_bias[:, 1:]).any(axis=1)
        dealer = Dealer(parts, most, False, row)

        def whole(values: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(values + [pa.nulls(len(values[0]), f.type) for f in dealt_fields], schema=target)

        def apart(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in found:
                yield pa.RecordBatch.from_arrays([pa.nulls(r.num_rows, f.type) for f in list(target)[: -len(dealt_fields)]] + r.columns, schema=target)

        for columns in sliced(batches):
            b = Batch(columns["text"], lower=True)
            t = m.read(b)
            doc = t.doc
            if paired:
                yield from apart(dealer.add(t.rest(), b.n))
            of_place = np.zeros(len(doc))  # with the class, in natural logarithms
            for part in t.runs():
                of_place[part] = log_softmax_at(m.weights, m.bias, [r[part] for r in t.rows], t.group[part])
                at = np.flatnonzero(several[t.group[part]]) + part.start
                if len(at):
                    of_place[at] += log_softmax_at(m.place_weights, m.place_bias[t.group[at]], [r[at] for r in t.place_rows], t.place[at])
            in_rest = t.place == 0
            of_class = of_place / np.log(10) + log_seen - np.where(in_rest, log_mass[t.group], 0)
            at = np.minimum(np.searchsorted(m.top, t.types), max(len(m.top) - 1, 0))
            known = m.top[at] == t.types if len(m.top) else np.zeros(len(t.types), dtype=bool)
            hit = known[t.type_of]
            base = np.where(known, log_count[at], 0)[t.type_of] if len(m.top) else np.zeros(len(doc))
            first = np.arange(b.n) + row
            row += b.n
            sums = [np.bincount(doc[hit], weights=v[hit], minlength=b.n) for v in (base, of_class + np.where(in_rest, base, 0))]
            yield whole([pa.array(first), pa.array(columns["doc_id"], pa.int64()), pa.nulls(b.n, pa.int64()), pa.array(b.n_words + 1), pa.array(np.bincount(doc[hit], minlength=b.n)), *map(pa.array, sums)])
            miss = np.flatnonzero(~hit)
            if len(miss):
                word = t.types[t.type_of[miss]]
                key = word ^ mix(doc[miss].astype(np.uint64))
                _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
                n = np.bincount(inverse)
                own = np.bincount(inverse, weights=of_class[miss])
                word, one = word[one], miss[one]
                nothing = pa.nulls(len(one), pa.int64())
                yield whole([pa.array(first[doc[one]]), nothing, pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), nothing, pa.nulls(len(one), pa.float64()), pa.array(own)])
        yield from apart(dealer.flush())

    # One pass gives the rows of documents, those of their rarer words, and the tokens in a rest.
    scored = written(docs.mapInArrow(tidied(run), SCORED), "scored")
    whole = scored.where("kind is null and word is null").select("row", "doc_id", F.col("n").alias("n_tokens"), "known", "base", "own")
    rare = scored.where("word is not null").select("row", "word", F.col("n").alias("times"), "own").join(vocabulary, "word", "left")
    seen = F.col("n").isNotNull()
    count = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(SMOOTH))
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(seen, F.col("times")).otherwise(0).alias("known"), (F.col("times") * count).alias("base"), F.when(seen, F.col("own") + F.col("times") * count).otherwise(F.col("times") * F.lit(float(np.log10(model.unseen)))).alias("own"))
    both = whole.union(rare)
    if paired:
        nothing = F.lit(0).cast("long")
        more = in_rest(scored.where("kind is not null").select(*dealt_fields.names), model)
        both = both.union(more.select("row", F.lit(None).cast("long"), nothing, nothing, F.lit(0.0), "own"))
    both = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "own")])
    spread = float(np.log10(model.tokens + SMOOTH * (model.types + 1)))
    return both.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(spread)).alias("base_score"), F.col("own").alias("score"))


def language_model(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out tenth and score all rows, in log10.

    A null or empty text is its end alone. Null ids aren't held out; repeated
    rows count and score one by one. Without training rows every word is the
    unseen one.
    """
    rows = with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = rows.where(~held_out("doc_id", 10, 0))
    model, vocabulary = fit(train)
    return score(rows, followers(train, model) if model.tokens else model, vocabulary)
