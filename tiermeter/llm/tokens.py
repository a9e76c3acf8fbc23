"""Token ids and token counts by a public tokenizer (op 4).

The tokenizer drops white space, so ids of a text are the ids of its words one
after another. White space is thus a safe boundary: texts are split there, and
each distinct word of a batch is encoded once. Words that an earlier batch had
come from a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tiermeter.llm.common import HELD, arrow_schema, tidied, with_bytes

VOCABULARY = "word_bpe_49k.json"
#: Words kept for good, and words kept until the table is full.
KEEP_WORDS, SPARE_WORDS = 300_000, 600_000
#: Bytes of text split into words at once, and of words encoded in one call.
PIECE_BYTES, CALL_BYTES, CALL_TEXT = 1 << 21, 1 << 18, 1200
_MARK = b"|"
#: Letters whose lower case and composed form are themselves, as the tokenizer's normaliser has it.
_SETTLED = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))


def _byte_letters() -> dict[int, str]:
    """The character that stands for each UTF-8 byte in a byte-level vocabulary, by Latin-1 code."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELT = _byte_letters()
_ENDS = b".,"
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


class WordEncoder:
    """Ids of words as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._plain([_MARK])[0]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words come once; the table below is the cache
        self.table: dict[bytes, bytes] = {b"": b""}
        self.kept: dict[bytes, bytes] | None = None

    def _plain(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, words: list[bytes]) -> None:
        """Put the distinct words of a batch into ``table``, emptied of later words when it is full."""
        table = self.table
        new = [w for w in words if w not in table]
        if len(table) + 2 * len(new) > KEEP_WORDS + SPARE_WORDS:
            if self.kept is None:
                self.kept = dict(islice(table.items(), KEEP_WORDS))
            table = self.table = dict(self.kept)
            new = [w for w in words if w not in table]
        whole, ends = [], []
        for w in new:
            # A run of "." and "," after an ASCII letter or digit is a piece of its own.
            core = w.rstrip(_ENDS).lower()
            if core != w and core[-1:].isalnum() and b"<|" not in w:
                end = w[len(core) :]
                ends.append((w, core, end))
                if core not in table:
                    whole.append(core)
                if end not in table:
                    whole.append(end)
            else:
                whole.append(w)
        self._encode(dict.fromkeys(whole))
        for w, core, end in ends:
            table[w] = table[core] + table[end]

    def _encode(self, words: Iterable[bytes]) -> None:
        """Encode words in calls of about CALL_BYTES, in texts of about CALL_TEXT with a mark between words."""
        tokenize, table = self.model.tokenize, self.table
        odd, plain = [], []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII letters: normalising changes nothing
                table[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            elif w.isascii() or w.decode().strip(_SETTLED):
                (odd if _MARK in w or b"<|" in w else plain).append(w)
            else:
                spelt = w.decode("latin-1").translate(_SPELT)
                table[w] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
        call: list[list[bytes]] = []
        group: list[bytes] = []
        size = total = 0
        for w in plain:
            group.append(w)
            size += len(w) + 3
            if size >= CALL_TEXT:
                call.append(group)
                total += size
                group, size = [], 0
                if total >= CALL_BYTES:
                    self._call(call)
                    call, total = [], 0
        if group:
            call.append(group)
        self._call(call)
        for i in range(0, len(odd), 1000):
            self.table.update(zip(odd[i : i + 1000], self._plain(odd[i : i + 1000]), strict=True))

    def _call(self, groups: list[list[bytes]]) -> None:
        if not groups:
            return
        for group, ids in zip(groups, self._plain([b" | ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(np.frombuffer(ids, dtype="<u4") == int.from_bytes(self.mark, "little"))
            if len(at) != len(group) - 1:  # the mark's id came from a word too
                self.table.update(zip(group, self._plain(group), strict=True))
                continue
            cuts = [*(at * 4).tolist(), len(ids)]
            self.table.update(zip(group, (ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts[:-1])], cuts, strict=True)), strict=True))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Each word's number, the ids of the numbered words, and where each text's words begin."""
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
        self.learn(distinct)
        begins = split.offsets.to_numpy() - split.offsets[0].as_py()
        return numbered.indices.to_numpy(), [self.table[w] for w in distinct], begins

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Token counts of texts."""
        number, ids, begins = self.words(texts)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        total = np.concatenate(([0], np.cumsum(size[number])))
        return np.diff(total[begins])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of texts."""
        number, ids, begins = self.words(texts)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        lengths = size[number]
        total = np.concatenate(([0], np.cumsum(lengths)))
        shift = (np.cumsum(size) - size)[number] - total[:-1]
        out = flat[np.repeat(shift, lengths) + np.arange(total[-1])]
        return [out[a:b] for a, b in pairwise(total[begins].tolist())]


def safe_cuts(text: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """Parts of about ``size`` bytes, cut only before white space; a word is never cut."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        cut = found.start() if found else len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


def balanced(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Batches of about ``size`` bytes and the number of the text that each part belongs to."""
    lengths = pc.binary_length(texts).to_numpy()
    group = np.cumsum(lengths + 1) // size
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(group, group[first], side="right")), first + 1)
        if lengths[first] > size:
            parts = safe_cuts(texts[first].as_py(), size)
            for k in range(len(parts)):
                yield pa.array([parts[k]], pa.binary()), np.array([first])
            first += 1
            continue
        long = np.flatnonzero(lengths[first:last] > size)
        last = first + int(long[0]) if len(long) else last
        yield texts[first:last], np.arange(first, last)
        first = last


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    return WordEncoder(path)


HELD["tokens"] = encoder.cache_clear


def tokenizer_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The document ids of each Arrow batch, and the token ids of its texts."""
    enc = encoder(path)
    for batch in batches:
        ids: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for texts, owner in balanced(batch.column("text")):
            for own, found in zip(owner.tolist(), enc.ids(texts.cast(pa.string())), strict=True):
                ids[own].append(found)
        yield batch.column("doc_id").to_pylist(), [x[0] if len(x) == 1 else np.concatenate(x) for x in ids]


COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Length in bytes and in tokens of every whole text; ids never leave Python.

    A null or empty text has 0 tokens; a null ``doc_id`` stays null; repeated
    rows are counted one by one; an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    target = arrow_schema(COUNT_SCHEMA)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column("text")
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for texts, owner in balanced(column):
                np.add.at(n, owner, enc.lengths(texts.cast(pa.string())))
            size = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], schema=target)

    return with_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(run, "tokens"), COUNT_SCHEMA)
