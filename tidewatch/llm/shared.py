"""What the text operators share: tables, words, folds, batches and grouped streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def free_name(wanted: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {name.lower() for name in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


class Memo(dict):
    """Results of a pure function by argument, forgotten when ``limit`` is reached.

    It bounds memory only: what was forgotten is computed again.
    """

    def __init__(self, function, limit: int = 150_000):
        super().__init__()
        self._function, self._limit = function, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._function(key)
        return value


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def split_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes.split knows just this white space."""
    return text.encode("utf-8", "surrogatepass").split()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts with null as the empty text."""
    return [value or "" for value in batch.column(name).to_pylist()]


def grouped(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys, from rows that arrive sorted by them."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[name] for name in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows
