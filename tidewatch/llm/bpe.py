"""Byte-pair encoding by a deterministic automaton over tokens.

``compile_automaton`` starts from the automaton that accepts every sequence of
base symbols: one state for each last token, an arc for each next token. Merges
are applied in order, each by the same gadget. For the merge ``u v -> w``

* the state reached by ``w`` gets the arcs of the state reached by ``v``,
* the arc ``v`` of the state reached by ``u`` goes away,
* every state with an arc ``u`` gets an arc ``w``.

What remains accepts exactly one token sequence for each word: the one that byte
pair encoding makes. Equal rows and equal columns of the arc table are merged,
which leaves a small table. A word is encoded by following the arcs whose labels
spell it; each prefix has one path, so the work is bounded by its length times
the longest label. Decoding emits the labels of the ids.

Defined results: null and empty texts have no ids and an empty decoded text;
other columns of the input stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import pieces, texts_of
from tidewatch.llm.token_words import PieceIds, WordSplitter, kept_by_worker


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 256
    for byte in range(256):
        if byte in printable:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(extra)
            extra += 1
    return letters


class Automaton:
    """Arc table with merged rows and columns, and the labels of the arcs."""

    def __init__(self, labels, end, rows, columns, table, splitter):
        self.labels = labels  # by token id
        self.end = end  # suffix of a word's last symbol
        self.rows = rows  # token id -> state; -1: a word ends there
        self.columns = columns  # token id -> class of arcs
        self.table = table  # state x class: a bit for each arc; the last state is the start
        self.splitter = splitter

    def ready(self) -> Automaton:
        """Look-up structures for encoding in one process."""
        special = set(self.splitter.special.values())
        self._last: dict[str, int] = {}  # labels that end a word, without the suffix
        self._inner: dict[str, int] = {}  # other labels and all their beginnings; -1: no label yet
        for number, label in enumerate(self.labels):
            if number in special or not label:
                continue
            if self.rows[number] < 0:
                self._last[label.removesuffix(self.end)] = number
            else:
                self._inner[label] = number
        self._longest = max(map(len, self._last), default=0)
        for label in list(self._inner):
            for stop in range(1, len(label)):
                self._inner.setdefault(label[:stop], -1)
        self._state, self._class = self.rows.tolist(), self.columns.tolist()
        self._arcs = [row.tobytes() for row in self.table]
        self._letters = byte_letters()
        self.splitter.ready()
        return self

    def encode_word(self, word: str) -> list[int]:
        """Ids of one normalized word."""
        if word in self.splitter.special:
            return [self.splitter.special[word]]
        letters = "".join([self._letters[b] for b in word.encode()])
        size = len(letters)
        came: list = [None] * (size + 1)
        state = [len(self._arcs) - 1] * size
        inner, last, classes = self._inner, self._last, self._class
        for start in range(size):
            arcs = self._arcs[state[start]]
            for stop in range(start + 1, size):
                token = inner.get(letters[start:stop])
                if token is None:
                    break
                if token >= 0:
                    column = classes[token]
                    if arcs[column >> 3] >> (column & 7) & 1:
                        came[stop] = (start, token)
                        state[stop] = self._state[token]
            # No ending label is longer, and a copy of the rest at every place would be quadratic.
            token = last.get(letters[start:]) if size - start <= self._longest else None
            if token is not None:
                column = classes[token]
                if arcs[column >> 3] >> (column & 7) & 1:
                    came[size] = (start, token)
        ids = []
        while size:
            size, token = came[size]
            ids.append(token)
        return ids[::-1]

    def decode(self, ids) -> str:
        """The labels of the ids with a space between them, as a vocabulary without a decoder does."""
        return " ".join([self.labels[i] for i in ids])


def _apply_merges(merges: list[tuple[str, str]], ids: dict[str, int], end: str):
    """Arcs as bits: for each token the set of states that have an arc for it."""
    inner = {token: n for n, token in enumerate(t for t in ids if not t.endswith(end) or t == end)}
    start = len(inner)
    made = {a + b for a, b in merges}
    base = [token for token in ids if token not in made]
    # Eight states share a row, so both the arcs of a state and the sources of an arc are one slice.
    arcs = np.zeros(((start + 8) // 8, len(ids)), np.uint8)
    for token in [*(t for t in base if t in inner), None]:
        row = start if token is None else inner[token]
        arcs[row >> 3, [ids[t] for t in base]] |= 1 << (row & 7)
    for left, right in merges:
        whole, u, v = ids[left + right], ids[left], ids[right]
        if left + right in inner:
            source, row = inner[right], inner[left + right]
            arcs[row >> 3] |= (arcs[source >> 3] >> (source & 7) & 1) << (row & 7)
        row = inner[left]
        arcs[row >> 3, v] &= 0xFF ^ (1 << (row & 7))
        arcs[:, whole] = arcs[:, u]
    return arcs, inner, start


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Different rows, and the number of each row's equal among them."""
    seen: dict[bytes, int] = {}
    number = [seen.setdefault(row.tobytes(), len(seen)) for row in rows]
    return np.frombuffer(b"".join(seen), rows.dtype).reshape(len(seen), rows.shape[1]), number


@lru_cache(maxsize=4)
def compile_automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file with word ends. Its size depends on the file only."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    splitter = WordSplitter(path)
    special = splitter.special
    vocab = {t: i for t, i in sorted(model["vocab"].items(), key=lambda x: x[1]) if t not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    position = {token: n for n, token in enumerate(vocab)}
    arcs, inner, start = _apply_merges(merges, position, end)
    distinct, column_of = _distinct(np.ascontiguousarray(arcs.T))
    bits = np.unpackbits(distinct, axis=1, bitorder="little")[:, : start + 1].T
    packed = np.packbits(bits, axis=1, bitorder="little")
    states, row_of = _distinct(packed[:start])
    table = np.concatenate([states, packed[start:]])
    size = max([*vocab.values(), *special.values()]) + 1
    labels, rows, columns = [""] * size, np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for token, n in position.items():
        labels[vocab[token]] = token
        columns[vocab[token]] = column_of[n]
        if token in inner:
            rows[vocab[token]] = row_of[inner[token]]
    for text, number in special.items():
        labels[number] = text
    return Automaton(labels, end, rows, columns, table, splitter)


def _code(automaton, path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = kept_by_worker(("automaton", path), lambda: automaton.value.ready())
        known = kept_by_worker(
            ("automaton ids", path),
            lambda: PieceIds(ready.splitter, lambda words: [ready.encode_word(w) for w in words], "i"),
        )
        for batch in pieces(batches, most=1_000_000):
            texts = [ready.splitter.pieces(text) for text in texts_of(batch)]
            known.learn(texts)
            raw = [b"".join(map(known.__getitem__, some)) for some in texts]
            ends = np.cumsum([0, *(len(ids) // 4 for ids in raw)])
            values = np.frombuffer(b"".join(raw), "<i4")
            decoded = [ready.decode(np.frombuffer(ids, "<i4").tolist()) for ids in raw]
            made = {
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                "decoded": pa.array(decoded, pa.string()),
            }
            arrays = [made[f.name] if f.name in made else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def encode_decode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids array<int>`` and ``decoded string`` of the whole text.

    The compiled automaton is broadcast; the vocabulary file bounds its size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(compile_automaton(tokenizer))
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    out = StructType([docs.schema[name] for name in keep])
    out = out.add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return read.mapInArrow(_code(automaton, tokenizer, to_arrow_schema(out)), out)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
