"""Benchmark decontamination by template windows.

A text becomes a sequence of template words: numbers, names (capitalised words)
and units after numbers turn into typed placeholders, other words lose case and
outer punctuation. Windows of eight template words are hashed; documents and
benchmark items meet in an equality join on the hash. Windows of one document
and item on one diagonal (document position less item position) are then put
together, and slots are compared: a value of the item must stand for one value
throughout, and two different names may not become one. An item that was given
other numbers or names so is still found; chance meetings of templates are not.
Windows whose slots are equal always count. If a value stands both for itself and
for another one, only windows with the other one go; if it stands for two others,
all changed windows of the diagonal go.

Each window has up to three forms, all hashed alike and joined together: with all
placeholders; with names as lower-cased words; and with no placeholder at all. The
first two need PLAIN_WORDS plain words, the last none. So a copy in other case, or
one of numbers and names alone, is found by its words.

A document is contaminated by an item if consistent diagonals cover 13 template
words of the item, or half of an item that has fewer than 26.

Before the join a bitmap of fixed size drops document windows that no item has.
It is the only thing that is broadcast; false positives of it end in the join.

Defined results: null and empty texts are clean; items shorter than a window
count as one window of their length, items without template words match
nothing; several items with equal texts are all named; null item_ids and
doc_ids are kept as they are; equal rows get equal results; further columns of
the inputs are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import pieces, split_words, texts_of

WINDOW = 8
#: Template words that make a leak, and the least number of plain words in a window.
LEAK_WORDS, PLAIN_WORDS = 13, 3
#: Bits of the bitmap: 8 MB, whatever the size of the benchmark.
FILTER_BITS = 26

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
#: Units and number words.
UNITS = frozenset(
    "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yard yards l ml liter liters litre litres"
    " gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month"
    " months year years dollar dollars euro euros cent cents pound pounds percent degree degrees kmh mph kw kwh".split()
)
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_PLAIN, _NUMBER, _NAME, _UNIT = range(4)
_BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def template_word(word: bytes) -> tuple[int, int, int, int, str] | None:
    """Kind and hash, kind and hash without regard to case, and folded form; None if only punctuation is in it."""
    core = word.decode("utf-8", "replace").strip(_EDGES)
    if not core:
        return None
    low, folded = core.lower(), core.casefold()
    own = xxhash.xxh64_intdigest(folded.encode())
    if core[0].isdigit() or low in NUMBER_WORDS:
        return _NUMBER, _NUMBER_HASH, _NUMBER, _NUMBER_HASH, folded
    plain = _UNIT if low in UNITS else _PLAIN
    if len(core) > 1 and core[0].isupper() and core[1:] == low[1:]:
        return _NAME, _NAME_HASH, plain, own, folded
    return plain, own, plain, own, folded


_NUMBER_HASH = xxhash.xxh64_intdigest(b"\x00number")
_NAME_HASH = xxhash.xxh64_intdigest(b"\x00name")
_UNIT_HASH = xxhash.xxh64_intdigest(b"\x00unit")


class Templates:
    """Template words of texts. Hashes and kinds stand in tables, by the number of a word."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.reset()

    def reset(self):
        self.number: dict[bytes, int] = {}
        self.folded: list[str] = []
        # With names, without names, and the words themselves.
        self.hash, self.kind = np.zeros((3, 1024), np.uint64), np.zeros((3, 1024), np.int8)

    def add(self, words: list[bytes]) -> None:
        while self.hash.shape[1] < len(self.number) + len(words):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)], axis=1)
            self.kind = np.concatenate([self.kind, np.zeros_like(self.kind)], axis=1)
        for n, word in enumerate(words, len(self.number)):
            self.number[word] = n
            kind, value, bare_kind, bare_value, folded = template_word(word) or (-1, 0, -1, 0, "")
            own = xxhash.xxh64_intdigest(folded.encode())
            self.kind[:, n], self.hash[:, n] = (kind, bare_kind, _PLAIN), (value, bare_value, own)
            self.folded.append(folded)

    def of(self, texts: list[str]):
        """Hashes and kinds by form of all template words in order, their folded forms, words and number of each text."""
        split = [split_words(text) for text in texts]
        held = set().union(*split)
        if len(self.number) + len(held.difference(self.number)) > self.limit:
            self.reset()
        self.add(list(held.difference(self.number)))
        words = list(chain.from_iterable(split))
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        kept = np.flatnonzero(self.kind[0, numbers] >= 0)
        numbers = numbers[kept]
        text = np.repeat(np.arange(len(texts)), [len(some) for some in split])[kept]
        value, kind = self.hash[:, numbers], self.kind[:, numbers]
        for form in (0, 1):
            unit = kind[form] == _UNIT
            counted = np.zeros(len(numbers), bool)
            counted[1:] = (kind[form, :-1] == _NUMBER) & (text[:-1] == text[1:])
            value[form, unit & counted] = _UNIT_HASH
            kind[form, unit & ~counted] = _PLAIN
        return value, kind, lambda n: self.folded[numbers[n]], np.bincount(text, minlength=len(texts)), text


def windows(value: np.ndarray, kind: np.ndarray, text: np.ndarray, width: int):
    """Starts, hashes and forms of the windows that lie in one text; equal forms of a window come once."""
    count = value.shape[1] - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = text[:count] == text[width - 1 :]
    earlier, found = [], []
    for form in range(3):
        total, factor = np.zeros(count, np.uint64), 1
        for k in range(width):
            total += value[form, k : k + count] * np.uint64(factor)
            factor = factor * _BASE & _ALL
        plain = np.concatenate([[0], np.cumsum(kind[form] == _PLAIN)])
        good = inside & (plain[width:] - plain[:-width] >= min(PLAIN_WORDS, width))
        new = good.copy()
        for others, there in earlier:
            new &= ~(there & (others == total))
        earlier.append((total, good))
        starts = np.flatnonzero(new)
        found.append((starts, _mixed(total[starts] + np.uint64(width)), np.full(len(starts), form)))
    return tuple(np.concatenate(part) for part in zip(*found))


_COLUMNS = "hash bigint, at int, width int, words int, slots array<string>"
_FIELDS = [
    ("hash", pa.int64()),
    ("at", pa.int32()),
    ("width", pa.int32()),
    ("words", pa.int32()),
    ("slots", pa.list_(pa.string())),
]


def _window_rows(keys: pa.Schema, passing, widths: tuple[int, ...]):
    """passing: None for all windows, or the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        bits = np.frombuffer(passing.value, np.uint8) if passing else None
        schema = pa.schema([*keys, *_FIELDS])
        for batch in pieces(batches):
            value, kind, core, size, text = templates.of(texts_of(batch))
            first = np.cumsum(size) - size
            for width in widths:
                starts, hashes, forms = windows(value, kind, text, width)
                if bits is not None:
                    place = hashes >> np.uint64(64 - FILTER_BITS)
                    held = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    starts, hashes, forms = starts[held], hashes[held], forms[held]
                elif width < WINDOW:  # only items of just that length
                    short = size[text[starts]] == width
                    starts, hashes, forms = starts[short], hashes[short], forms[short]
                if not len(starts):
                    continue
                row = text[starts]
                slots = [
                    [f"{k - s}:{kind[form, k]}:{core(k)}" for k in range(s, s + width) if kind[form, k] != _PLAIN]
                    for s, form in zip(starts.tolist(), forms.tolist())
                ]
                made = [
                    pa.array(hashes.view(np.int64)),
                    pa.array((starts - first[row]).astype(np.int32)),
                    pa.array(np.full(len(starts), width, np.int32)),
                    pa.array(size[row].astype(np.int32)),
                    pa.array(slots, pa.list_(pa.string())),
                ]
                names = [batch.column(f.name).take(pa.array(row)) for f in keys]
                yield pa.RecordBatch.from_arrays([*names, *made], schema=schema)

    return run


def _rows(frame: DataFrame, passing, widths: tuple[int, ...]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    keys = StructType([f for f in frame.schema if f.name != "text"])
    out = StructType([*keys, *_parse_datatype_string(_COLUMNS)])
    return frame.mapInArrow(_window_rows(to_arrow_schema(keys), passing, widths), out)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Template windows of all items; ``item`` tells items apart where ids repeat."""
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    return _rows(items, None, tuple(range(1, WINDOW + 1)))


def _bitmap(found: DataFrame) -> bytes:
    """Which hash prefixes occur: at most 2**FILTER_BITS of them, whatever the input."""
    word = F.shiftrightunsigned("hash", 64 - FILTER_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))")
    words = found.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words.toLocalIterator():
        bits[row["word"]] = row["bits"] & _ALL
    return bits.astype("<u8").tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, ``text_key`` (hash of the text), item_id and covered words of each leak."""
    from tidewatch.sources.storage import store

    spark = docs.sparkSession
    of_items = store(benchmark_windows(benchmark), "benchmark-windows")
    widths = tuple(sorted(r["width"] for r in of_items.select("width").distinct().collect()))
    passing = spark.sparkContext.broadcast(_bitmap(of_items))
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text").where(F.col("text").isNotNull())
    of_docs = _rows(keyed, passing, widths)
    met = (
        of_docs.select("doc_id", "text_key", "hash", "at", "slots")
        .join(of_items.select("hash", "item_id", "item", F.col("at").alias("item_at"), "width", "words", F.col("slots").alias("item_slots")), "hash")
    )
    pairs = F.zip_with(
        "item_slots",
        "slots",
        lambda a, b: F.struct(F.regexp_replace(a, "^[0-9]+:", "").alias("item"), F.regexp_replace(b, "^[0-9]+:", "").alias("doc")),
    )
    # A diagonal has at most three times as many windows as the item has words.
    diagonal = met.groupBy("doc_id", "text_key", "item_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("item_at", "width", pairs.alias("pairs"))).alias("windows"), F.max("words").alias("words")
    ).withColumn("pairs", F.array_distinct(F.flatten(F.col("windows")["pairs"])))

    def itself(p: Column) -> Column:
        return p["item"] == p["doc"]

    def rival(p: Column, q: Column) -> Column:
        two_names = p["item"].startswith(f"{_NAME}:") & q["item"].startswith(f"{_NAME}:")
        return (p["item"] == q["item"]) | (two_names & (p["doc"] == q["doc"]))

    clashing = F.filter("pairs", lambda p: ~itself(p) & F.exists("pairs", lambda q: (p != q) & rival(p, q)))
    held = diagonal.withColumn("clashing", clashing).withColumn(
        "broken",
        F.exists("clashing", lambda p: ~F.exists("pairs", lambda q: itself(q) & rival(p, q))),
    )
    counted = F.filter(
        "windows",
        lambda w: F.forall(w["pairs"], itself)
        | (~F.col("broken") & ~F.arrays_overlap(w["pairs"], F.col("clashing"))),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(counted, lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1)))
    )
    per_item = (
        held.withColumn("covered", covered)
        .groupBy("doc_id", "text_key", "item_id", "item")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
            F.max("words").alias("words"),
        )
    )
    enough = F.least(F.lit(LEAK_WORDS), F.ceil(F.col("words") / 2))
    return per_item.where(F.col("covered") >= enough).select("doc_id", "text_key", "item_id", "covered")


def text_key() -> Column:
    return F.xxhash64("text")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with ``contaminated``, ``n_items`` and ``item_ids``."""
    leaks = find_leaks(docs, benchmark).groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids")
    )
    rows = docs.select("doc_id", text_key().alias("text_key"))
    joined = rows.join(
        leaks.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"}),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")),
        "left",
    )
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(
        F.col("doc_id").alias("_leaked_doc_id"), F.col("text_key").alias("_leaked_text_key")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_leaked_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_leaked_text_key"))
    return docs.join(leaks, same, "left_anti")
