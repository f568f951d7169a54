"""Token counts of documents, by the counts of their distinct pre-tokens.

A byte-level BPE never merges across pre-tokens, so the number of ids of a text
is the sum over its pre-tokens. The work therefore goes by distinct pre-tokens:

1. every task counts how often each of its pre-tokens stands; the sums of all
   tasks are the vocabulary of the corpus
2. the pieces of each distinct pre-token are counted once, and stored
3. the pre-token frequencies of a document meet these counts: frequent
   pre-tokens in a table that all tasks hold, all others in an equality join
4. frequency times pieces is summed per document; no id is ever made

The table of step 3 holds at most ``frequent`` pre-tokens of at most
``FREQUENT_LETTERS`` letters, so its size does not grow with the corpus. It keeps
the most common keys, which would pile up in one task, out of the join.

Defined results: a null text is empty and has 0 tokens; special strings inside a
text are one token each, as the library takes them; equal rows stay as they are,
and so do null ids; an empty table gives no rows; other columns of the input are
not used. A text is read in parts, so a long one costs memory for its distinct
pre-tokens only.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import pieces, texts_of
from tidewatch.sources.storage import store

#: Bounds of the table of frequent pre-tokens.
FREQUENT, FREQUENT_LETTERS = 400_000, 32
#: Distinct pre-tokens that a task sums up before it hands them on.
_HELD = 400_000
_PART = 100_000

#: The pre-token pattern of byte-level vocabularies (fixed value), for letters whose kind is beyond doubt.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything but letters, digits and signs that every edition of Unicode since long sorts alike.
_DOUBT = re.compile(
    "[^\x00-\x1b -\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԓ"
    "‐-‧€ぁ-ゖァ-ヺ一-龥가-힣]"
)
#: A pre-token that holds a sign never goes on with a space.
_CUT = re.compile(r"[^\s\x1c-\x1f](?=[ \n])")


class PreTokens:
    """Frequencies of pre-tokens, as the vocabulary file's splitter gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if spec["normalizer"] or not plain:
            raise ValueError("this counter knows byte-level vocabularies without normalizer and prefix space")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if any(token[flag] for token in spec["added_tokens"] for flag in flags):
            raise ValueError("this counter knows added tokens that stand for just their text")
        self.path = path
        self.special = [token["content"] for token in spec["added_tokens"]]

    def ready(self) -> PreTokens:
        """Make what does not travel to a task."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(self.path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        longest = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        return self

    def parts(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in parts of bounded size; special strings stand as they are."""
        held = self._special and any(name in text for name in self.special)
        for part in self._special.split(text) if held else [text]:
            if held and part in self.special:
                yield [part]
                continue
            start = 0
            while start < len(part):
                cut = _CUT.search(part, start + _PART)
                end = cut.end() if cut else len(part)
                yield self._split(part[start:end])
                start = end

    def frequencies(self, text: str) -> Counter:
        """Frequency of each pre-token."""
        found: Counter = Counter()
        for part in self.parts(text):
            found.update(part)
        return found

    def _split(self, part: str) -> list[str]:
        if not _DOUBT.search(part):
            return _QUICK.findall(part)
        return [part[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def sizes(self, some: list[str]) -> list[int]:
        """Number of pieces of each pre-token."""
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]


def _count_pre_tokens(split: PreTokens):
    schema = pa.schema([("piece", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = split.ready(), Counter()
        for batch in pieces(batches):
            for text in texts_of(batch):
                for part in words.parts(text):
                    held.update(part)
                if len(held) >= _HELD:
                    yield pa.RecordBatch.from_pydict({"piece": list(held), "times": list(held.values())}, schema)
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"piece": list(held), "times": list(held.values())}, schema)

    return run


def _count_pieces(split: PreTokens):
    schema = pa.schema([("piece", pa.string()), ("times", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = split.ready()
        for batch in pieces(batches, "piece"):
            known = batch.column("piece")
            sizes = pa.array(words.sizes(known.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([known, batch.column("times"), sizes], schema=schema)

    return run


def vocabulary(docs: DataFrame, split: PreTokens) -> DataFrame:
    """``piece, times, n``: each distinct pre-token, how often it stands in the corpus, its number of pieces."""
    held = docs.select("text").mapInArrow(_count_pre_tokens(split), "piece string, times bigint")
    distinct = held.groupBy("piece").agg(F.sum("times").alias("times"))
    return store(distinct.mapInArrow(_count_pieces(split), "piece string, times bigint, n bigint"), "pre-tokens")


def frequent_sizes(words: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """Pieces of the most frequent pre-tokens, and how often a pre-token must stand to be one.

    The bound comes from a histogram over powers of two, so the driver gets at most ``most`` rows.
    """
    short = words.where(F.length("piece") <= FREQUENT_LETTERS)
    level = F.floor(F.log2("times")).cast("int")
    held, bound = 0, 1
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > most:
            bound = 2 ** (row["level"] + 1)
            break
    rows = short.where(F.col("times") >= bound).select("piece", "n").toArrow()
    return dict(zip(rows.column("piece").to_pylist(), rows.column("n").to_pylist())), bound


def _document_rows(split: PreTokens, frequent):
    """One row with the tokens of frequent pre-tokens per document, one for each other pre-token of it."""
    schema = pa.schema(
        [
            ("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
            ("known", pa.int64()), ("piece", pa.string()), ("times", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = split.ready(), frequent.value
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], [], []]
            given = (batch.column(name).to_pylist() for name in ("row", "doc_id", "n_bytes"))
            for text, row, doc_id, n_bytes in zip(texts_of(batch), *given):
                known, rest, times = 0, [], []
                for piece, count in words.frequencies(text).items():
                    size = sizes.get(piece)
                    if size is None:
                        rest.append(piece)
                        times.append(count)
                    else:
                        known += size * count
                # A key of its own keeps the document's row out of any group of the join.
                more = len(rest)
                values = ([row] * (more + 1), [doc_id] + [None] * more, [n_bytes] + [None] * more,
                          [known] + [0] * more, [f"{row}/{doc_id}", *rest], [0, *times])
                for column, value in zip(out, values):
                    column.extend(value)
                if len(out[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
                    out = [[], [], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens are more than ``limit``, for each row of ``docs``."""
    split = PreTokens(tokenizer)
    words = vocabulary(docs, split)
    sizes, bound = frequent_sizes(words, frequent)
    sent = docs.sparkSession.sparkContext.broadcast(sizes)
    # Equal rows are told apart by where they stand in the input.
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    kinds = "row bigint, doc_id bigint, n_bytes bigint, known bigint, piece string, times bigint"
    rows = texts.mapInArrow(_document_rows(split, sent), kinds)
    others = words.where((F.col("times") < bound) | (F.length("piece") > FREQUENT_LETTERS)).select("piece", "n")
    counted = F.col("known") + F.col("times") * F.coalesce("n", F.lit(0))
    summed = (
        rows.join(others, "piece", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(counted).alias("n_tokens"))
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
