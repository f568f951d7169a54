"""Removal of repeated passages with a compressed FM-index per shard.

A passage is a window of 13 words. Each text is cut into segments: runs of
windows with one minimizer (the smallest hash of the three-word sequences in a
window). Equal windows have equal minimizers, so sending segments to shards by
their minimizer brings all copies of a window into one shard, and shards need
not look at each other. Segments travel packed by batch and shard, equal ones of
a batch once with the list of their places.

A shard drops segments whose minimizer no second segment or document has. Over
the words of the others it builds an FM-index: suffixes sorted to 13 words, the
Burrows-Wheeler transform in a wavelet matrix of packed bits, and group borders
for dropping the last word of a match. All segments are streamed through it from
right to left, side by side: a backward step adds a word, a border look-up drops
one, so each step has the suffix interval of the next 13 words. The smallest
doc_id of an interval tells whether its window starts in an earlier document;
nothing else of the sort is kept for that. Such windows go back to the documents.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has no
words; texts under 13 words stay whole; windows repeated within a document only
stay; rows with one doc_id do not remove each other's words; a row with a null
doc_id is neither source nor target; equal rows get equal results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tidewatch.llm.shared import Memo, grouped, pieces, split_words, texts_of

WINDOW, GRAM = 13, 3
#: Text bytes of a shard, and windows of a segment at most.
SHARD_BYTES, SEGMENT_WINDOWS = 8_000_000, 64
#: Text bytes of a batch, whose segments are packed together, and effort of packing.
BATCH_BYTES, EFFORT = 8_000_000, 9


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(33))


# --- segments -----------------------------------------------------------------


def segment_bounds(hashes: np.ndarray, doc: np.ndarray):
    """Start, end and mixed minimizer of each segment of the texts put one after another."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams = _mixed(grams)
    least = grams[:count].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[k : k + count], out=least)
    whole = doc[:count] == doc[WINDOW - 1 :]
    fresh = np.ones(count, bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1:count] != doc[: count - 1])
    at = np.arange(count)
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= (at - run) % SEGMENT_WINDOWS == 0
    first = np.flatnonzero(fresh & whole)
    stops = np.flatnonzero(np.concatenate([(fresh | ~whole)[1:], [True]]) & whole)
    return first, stops + WINDOW, _mixed(least[first])


def pack(minimizers, places, segments: list[bytes]) -> bytes:
    """places: arrays of segment number, doc_id, crc32 of the text, first word."""
    number, doc, crc, first = places
    raw = [
        struct.pack("<II", len(segments), len(number)),
        minimizers.astype("<u4").tobytes(),
        number.astype("<u4").tobytes(),
        doc.astype("<i8").tobytes(),
        crc.astype("<u4").tobytes(),
        first.astype("<u4").tobytes(),
        b"\n".join(segments),
    ]
    return zstandard.ZstdCompressor(level=EFFORT).compress(b"".join(raw))


def unpack(payload: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    segments, places = struct.unpack_from("<II", raw)
    at, arrays = 8, []
    for kind, size in (("<u4", segments), ("<u4", places), ("<i8", places), ("<u4", places), ("<u4", places)):
        arrays.append(np.frombuffer(raw, kind, size, at))
        at += arrays[-1].nbytes
    return arrays, raw[at:].split(b"\n")


_PACKS = pa.schema([("shard", pa.int32()), ("payload", pa.binary())])


def _cut(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Memo(xxhash.xxh64_intdigest)
        for batch in pieces(batches, most=BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            texts = texts_of(batch)
            split = [split_words(text) if i is not None else [] for i, text in zip(ids, texts)]
            words = [word for some in split for word in some]
            sizes = np.array([len(some) for some in split])
            doc = np.repeat(np.arange(len(split)), sizes)
            hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
            first, stop, minimizer = segment_bounds(hashes, doc)
            if not len(first):
                continue
            seen: dict[bytes, int] = {}
            number = np.fromiter(
                (
                    seen.setdefault(b" ".join(words[a:b]), len(seen))
                    for a, b in zip(first.tolist(), stop.tolist())
                ),
                np.int64,
                len(first),
            )
            distinct = list(seen)
            own = np.zeros(len(distinct), np.uint64)
            own[number] = minimizer
            shard = (own % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")  # segments by shard
            within = np.empty(len(order), np.int64)  # number of a segment in its shard
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
            within[order] = np.arange(len(order)) - np.repeat(edges, np.diff(edges, append=len(order)))
            by_place = np.argsort(shard[number], kind="stable")
            place_shard = shard[number][by_place]
            where = doc[first][by_place]
            id_of = np.array([i or 0 for i in ids], np.int64)[where]
            crc_of = np.array([crc32(text.encode("utf-8", "surrogatepass")) for text in texts], np.uint32)[where]
            start = (first - (np.cumsum(sizes) - sizes)[doc[first]])[by_place]
            local = within[number][by_place]
            out: tuple[list, list] = ([], [])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                name = int(shard[order[a]])
                c, d = np.searchsorted(place_shard, [name, name + 1]).tolist()
                places = (local[c:d], id_of[c:d], crc_of[c:d], start[c:d])
                some = order[a:b]
                out[0].append(name)
                out[1].append(
                    pack((own[some] >> np.uint64(32)), places, [distinct[n] for n in some.tolist()])
                )
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _PACKS)], schema=_PACKS)

    return run


# --- index --------------------------------------------------------------------


def _packed(bit: np.ndarray) -> np.ndarray:
    """Bits in words of 64."""
    words = np.zeros(len(bit) // 64 + 1, np.uint64)
    held = np.packbits(bit, bitorder="little")
    words.view(np.uint8)[: len(held)] = held
    return words


def _before(words: np.ndarray) -> np.ndarray:
    """How many bits are set before each word."""
    counts = np.zeros(len(words), np.uint32)
    np.cumsum(np.bitwise_count(words[:-1]), dtype=np.uint32, out=counts[1:])
    return counts


def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each position."""
    word = at >> 6
    below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return counts[word].astype(np.int64) + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, (symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (sequence >> (self.levels - 1 - level)) & 1
            words = _packed(bit.astype(np.uint8))
            self.bits.append(words)
            self.counts.append(_before(words))
            one = bit == 1
            self.zeros.append(int(len(sequence) - one.sum()))
            sequence = np.concatenate([sequence[~one], sequence[one]])
        self.first = np.zeros(symbols, np.int64)
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = _ones(self.bits[level], self.counts[level], at)
            high = (symbol >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(high, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, at) - self.first[symbol]


def _joined(*keys: np.ndarray) -> np.ndarray:
    """Numbers that order as tuples of the keys do."""
    joined = keys[0].astype(np.int64)
    for key in keys[1:]:
        wide = int(key.max()) + 1
        if (int(joined.max()) + 1) * wide >= 1 << 62:
            joined = np.unique(joined, return_inverse=True)[1]
        joined = joined * wide + key
    return joined


class FMIndex:
    """Backward search for windows in a text of word numbers (from 1; 0 ends a segment).

    Kept are the transform in a wavelet matrix, the borders of the groups that
    agree in all words of a window but the last (one packed bit a suffix), and
    the ``values`` of the text's places in the order of suffixes. Suffixes are
    sorted to a window; the order of equal ones is left open, since a match is
    a window at most.
    """

    def __init__(self, text: np.ndarray, symbols: int, values: np.ndarray):
        size = len(text)

        def later(ranks: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([ranks[by:], np.zeros(by, ranks.dtype)])

        def ranks(*keys: np.ndarray) -> np.ndarray:
            return np.unique(_joined(*keys), return_inverse=True)[1]

        three = ranks(text, later(text, 1), later(text, 2))
        nine = ranks(three, later(three, 3), later(three, 6))
        del three
        order = np.argsort(_joined(nine, later(nine, WINDOW - 9)))
        a, b = nine[order], later(nine, WINDOW - 10)[order]
        new = np.ones(size, np.uint8)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        del nine, a, b
        self.size = size
        self.borders = _packed(new)
        self.borders_before = _before(self.borders)
        self.starts = np.append(np.flatnonzero(new), size).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.matrix = WaveletMatrix(text[order - 1], symbols)
        self.values = values[order]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value in each interval of a whole window; equal or apart, such intervals never overlap."""
        end = np.zeros(self.size, np.int64)
        end[low] = high
        first = np.flatnonzero(end)
        if not len(first):
            return np.zeros(0, np.int64)
        pairs = np.stack([first, end[first]], axis=1).ravel()
        end[first] = np.minimum.reduceat(np.append(self.values, np.iinfo(np.int64).max), pairs)[::2]
        return end[low]

    def shortened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of windows without their last word."""
        group = _ones(self.borders, self.borders_before, low + 1)
        return self.starts[group - 1].astype(np.int64), self.starts[group].astype(np.int64)

    def window_matches(self, text: np.ndarray, first: np.ndarray, size: np.ndarray):
        """For each window of each stream: its position in ``text`` and its suffix interval.

        Streams go side by side from right to left. The first 13 steps only
        extend; each later one drops the last word and adds one in front.
        """
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), self.size, np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            at = first[:live] + size[:live] - 1 - step
            symbol = text[at]
            lo, hi = low[:live], high[:live]
            if step >= WINDOW:
                found = lo < hi
                wide = self.shortened(np.where(found, lo, 0))
                lo, hi = (np.where(found, border, 0) for border in wide)
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            low[:live] = self.before[symbol] + both[:live]
            high[:live] = self.before[symbol] + both[live:]
            if step >= WINDOW - 1:
                yield at, low[:live].copy(), high[:live].copy()


def repeated_intervals(segments: list[bytes], minimizers: np.ndarray, places):
    """doc_id, crc, start and end (in words) of runs of windows that start in a smaller doc_id."""
    number, doc, crc, first_word = places
    count = len(segments)
    smallest = np.full(count, np.iinfo(np.int64).max)
    largest = np.full(count, np.iinfo(np.int64).min)
    np.minimum.at(smallest, number, doc)
    np.maximum.at(largest, number, doc)
    # Only minimizers of two documents or more can hold a repeated window.
    group = np.unique(minimizers, return_inverse=True)[1]
    low = np.full(group.max() + 1, np.iinfo(np.int64).max)
    high = np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, smallest)
    np.maximum.at(high, group, largest)
    live = np.flatnonzero((low < high)[group])
    if not len(live):
        return
    words: dict[bytes, int] = {}
    split = [segments[n].split(b" ") for n in live.tolist()]
    for some in split:
        for word in some:
            if word not in words:
                words[word] = len(words) + 1
    size = np.array([len(some) for some in split])
    text = np.zeros(int(size.sum()) + len(split), np.int64)
    first = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(split)), size + 1)
    inside = np.ones(len(text), bool)
    inside[first + size] = False
    text[inside] = np.fromiter((words[w] for some in split for w in some), np.int64, int(size.sum()))
    index = FMIndex(text, len(words) + 1, smallest[live][owner])
    # Interval of the window at each place, and the smallest document that holds it.
    low_of, high_of = np.zeros(len(text), np.uint32), np.zeros(len(text), np.uint32)
    for at, lo, hi in index.window_matches(text, first, size):
        low_of[at], high_of[at] = lo, hi
    met = np.flatnonzero(low_of < high_of)
    earliest = np.full(len(text), np.iinfo(np.int64).max)
    earliest[met] = index.least(low_of[met].astype(np.int64), high_of[met].astype(np.int64))
    del index, low_of, high_of, met

    # Places of live segments, against the windows of their segment.
    slot = np.full(count, -1)
    slot[live] = np.arange(len(live))
    held = np.flatnonzero(slot[number] >= 0)
    windows = size[slot[number[held]]] - WINDOW + 1
    limits = np.cumsum(windows)
    start = 0
    while start < len(held):
        base = int(limits[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(limits, base + 2_000_000)))
        some, many = held[start:stop], windows[start:stop]
        row = np.repeat(np.arange(len(some)), many)
        within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        hit = earliest[first[slot[number[some]]][row] + within] < doc[some][row]
        opens = hit & ~(np.concatenate([[False], hit[:-1]]) & (within > 0))
        last = within == many[row] - 1
        closes = hit & ~(np.concatenate([hit[1:], [False]]) & ~last)
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        owner_of = some[row[a]]
        yield (
            doc[owner_of],
            crc[owner_of].astype(np.int64),
            first_word[owner_of] + within[a],
            first_word[owner_of] + within[b] + WINDOW,
        )
        start = stop


_RUNS = pa.schema([(name, pa.int64()) for name in ("doc_id", "crc", "start", "stop")])


def _search():
    def shard_of(payloads: list[bytes]):
        """Equal segments of all batches become one."""
        seen: dict[bytes, int] = {}
        minimizers, parts = [], []
        for payload in payloads:
            (own, number, doc, crc, first), segments = unpack(payload)
            known = len(seen)
            to = np.fromiter((seen.setdefault(s, len(seen)) for s in segments), np.int64, len(segments))
            new = to >= known
            minimizers.append(own[new])
            parts.append((to[number], doc, crc, first.astype(np.int64)))
        return list(seen), np.concatenate(minimizers), [np.concatenate(p) for p in zip(*parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ("shard",)):
            segments, minimizers, places = shard_of([row["payload"] for row in rows])
            for arrays in repeated_intervals(segments, minimizers, places):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in arrays], schema=_RUNS)

    return run


def _strip(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, total, removed = [], [], []
            for text, starts, stops in zip(
                texts_of(batch), batch.column("starts").to_pylist(), batch.column("stops").to_pylist()
            ):
                words = split_words(text)
                total.append(len(words))
                if starts:
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, np.array(starts), 1)
                    np.add.at(change, np.array(stops), -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    removed.append(len(words) - len(stay))
                    words = [words[n] for n in stay.tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            made = {"n_words": total, "n_removed": removed, "kept": kept}
            arrays = [
                pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``: the words that stay, joined by single spaces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(16, -(-size // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packs = rows.where(F.col("text").isNotNull()).mapInArrow(_cut(shards), "shard int, payload binary")
    runs = (
        packs.repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_search(), "doc_id bigint, crc bigint, start bigint, stop bigint")
    )
    # A document has at most as many runs as words.
    found = runs.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("start", "stop")).alias("runs")).select(
        "doc_id", "crc", F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = rows.withColumn("crc", F.crc32(text.cast("binary")))
    joined = keyed.join(found, ["doc_id", "crc"], "left").select("doc_id", "text", "starts", "stops")
    out = StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType())
    out = out.add("kept", StringType())
    return joined.mapInArrow(_strip(to_arrow_schema(out)), out)
