"""Token ids in files, with document boundaries in Elias-Fano form.

File format (Parquet as the container, so any store that Spark reaches will do).
Each row of ``blocks`` is one run of documents in ascending doc_id:

    part, block   position: parts in doc_id order, blocks within a part
    before        ids in earlier blocks of the part
    doc_ids       doc_id of each document
    n_ids         ids in the block, end ids included
    width         bytes of an id, 2 or 4, little-endian
    ids           the concatenated ids
    low_bits      l, bits of a boundary kept verbatim
    low           the l low bits of each boundary, packed
    high          unary coded high parts: boundary i sets bit (b_i >> l) + i
    samples       positions of every 256th set bit of ``high``, for select

A boundary is the end of a document within its block. The structure takes
2 + log2(n_ids / documents) bits a document. ``parts`` holds one row for each
part with the number of ids before it.

Defined results: a null text is empty, so it holds the end id alone; equal
doc_ids stand in the order of a hash of their texts; null doc_ids come first; an
empty table gives no blocks; other columns of the input are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shared import pieces, texts_of
from tidewatch.llm.token_words import (
    PieceIds,
    WordSplitter,
    kept_by_worker,
    library_encoder,
    vocabulary_size,
)
from tidewatch.sources.storage import fresh_path

#: A block is closed at this many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 2_000_000, 50_000
_SAMPLE = 256
#: Bytes of text that are encoded at once.
_BATCH = 8_000_000

_BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("before", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("width", pa.int32()),
        ("ids", pa.binary()),
        ("low_bits", pa.int32()),
        ("low", pa.binary()),
        ("high", pa.binary()),
        ("samples", pa.list_(pa.int32())),
    ]
)
_BLOCKS_SQL = (
    "part int, block int, before bigint, doc_ids array<bigint>, n_ids bigint, width int, ids binary,"
    " low_bits int, low binary, high binary, samples array<int>"
)


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        self.samples = samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count = len(values)
        top = int(values[-1]) if count else 0
        low_bits = max(0, (top // max(count, 1)).bit_length() - 1)
        at = (values >> low_bits) + np.arange(count)
        bits = np.zeros(int(at[-1]) + 1 if count else 0, np.uint8)
        bits[at] = 1
        shifts = np.arange(low_bits)
        low = ((values[:, None] >> shifts) & 1).astype(np.uint8) if low_bits else np.zeros(0, np.uint8)
        return cls(
            count,
            low_bits,
            np.packbits(low.ravel(), bitorder="little").tobytes(),
            np.packbits(bits, bitorder="little").tobytes(),
            at[::_SAMPLE].astype(np.int32).tolist(),
        )

    def select(self, index: int) -> int:
        """Number ``index``: from the nearest sample on, by counting set bits of bytes."""
        position = self.samples[index // _SAMPLE]
        missing = index % _SAMPLE
        byte = position >> 3
        word = self.high[byte] >> (position & 7) << (position & 7)
        while (held := word.bit_count()) <= missing:
            missing -= held
            byte += 1
            word = self.high[byte]
        for _ in range(missing):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - index
        start = index * self.low_bits
        raw = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3], "little")
        return high << self.low_bits | raw >> (start & 7) & ((1 << self.low_bits) - 1)


def _block(part: int, number: int, before: int, doc_ids: list, parts: list[bytes], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(ids) // width for ids in parts])
    boundaries = EliasFano.of(ends)
    row = [
        part, number, before, doc_ids, int(ends[-1]), width, b"".join(parts),
        boundaries.low_bits, boundaries.low, boundaries.high, boundaries.samples,
    ]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)


def _pack(tokenizer: str, splitter: WordSplitter, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, code = f"<u{width}", {2: "H", 4: "I"}[width]
        split = splitter.ready()
        known = kept_by_worker(
            ("library", tokenizer, kind), lambda: PieceIds(split, library_encoder(tokenizer), code)
        )
        end = np.array([end_id], kind).tobytes()
        part = TaskContext.get().partitionId()
        number = held = before = 0
        doc_ids: list = []
        rows: list[bytes] = []
        for batch in pieces(batches, most=_BATCH):
            texts = [split.pieces(text) for text in texts_of(batch)]
            known.learn(texts)
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), texts):
                ids = b"".join(map(known.__getitem__, words)) + end
                doc_ids.append(doc_id)
                rows.append(ids)
                held += len(ids) // width
                if held >= BLOCK_IDS or len(rows) >= BLOCK_DOCS:
                    yield _block(part, number, before, doc_ids, rows, width)
                    number, before, held, doc_ids, rows = number + 1, before + held, 0, [], []
        if rows:
            yield _block(part, number, before, doc_ids, rows, width)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode whole texts and write ``path/blocks`` and ``path/parts``."""
    width = 2 if max(vocabulary_size(tokenizer) - 1, end_id) < 1 << 16 else 4
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    blocks = ordered.mapInArrow(_pack(tokenizer, WordSplitter(tokenizer), end_id, width), _BLOCKS_SQL)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    sizes = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks").select("part", "n_ids")
    # One row for each part, whatever the number of documents.
    rows, start = [], 0
    for row in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        rows.append((row["part"], start))
        start += row["n"]
    spark.createDataFrame(rows, "part int, start bigint").coalesce(1).write.parquet(f"{path}/parts")


_READ_SQL = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _unpack(starts: dict, with_ids: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
        + ([("ids", pa.binary())] if with_ids else [("ids_crc32", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids = row["doc_ids"]
                coded = EliasFano(len(doc_ids), row["low_bits"], row["low"], row["high"], row["samples"])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                start, first, sizes, last = 0, [], [], []
                for number in range(len(doc_ids)):
                    end = coded.select(number)
                    text = ids[start:end].tobytes()
                    first.append(starts[row["part"]] + row["before"] + start)
                    sizes.append(end - start)
                    last.append(text if with_ids else zlib.crc32(text))
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip((doc_ids, first, sizes, last), schema)],
                    schema=schema,
                )

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start and n_tokens of each document, with its ids or their crc32."""
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks")
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}
    out = "doc_id bigint, start bigint, n_tokens bigint, " + ("ids binary" if with_ids else "ids_crc32 bigint")
    return blocks.mapInArrow(_unpack(starts, with_ids), out)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and return what they hold, by document."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)
