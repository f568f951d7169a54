"""ST2: each record once, however often and late it comes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Ids that share a row of the ledger: 2 to this power.
_BITS = 12
_SPAN = 1 << _BITS
#: Keys that a task remembers to drop copies before they move; more only cost moving them.
_REMEMBERED = 100_000
#: Rows that a task bundles at once, without the copies among them.
_BUNDLED = 100_000

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def packed(places: bytearray) -> bytes:
    """The bitmap of a span, as a sorted list of two-byte places where that is shorter."""
    held = np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8), bitorder="little"))
    return held.astype("<u2").tobytes() if 2 * len(held) < len(places) else bytes(places)


def unpacked(held: bytes | None) -> bytearray:
    """The inverse of ``packed``."""
    if held is not None and len(held) == _SPAN // 8:
        return bytearray(held)
    bits = np.zeros(_SPAN, np.uint8)
    bits[np.frombuffer(held or b"", "<u2")] = 1
    return bytearray(np.packbits(bits, bitorder="little").tobytes())


#: Rows of one span that a task met together: which places, and the rows themselves as an Arrow message.
_BUNDLE = "_span string, _places binary, _rows binary"
_KEPT = "_rows binary, _keep binary"


class IdLedger(StatefulProcessor):
    """The ids seen so far, in spans: one bit an id, or two bytes while a span holds few.

    A batch reads the spans of its own ids. For spans that are new, the filters of
    the store answer without a read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "ids binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._seen.get()
        places = np.frombuffer(unpacked(held[0] if held else None), np.uint8)
        seen, changed = np.unpackbits(places, bitorder="little"), False
        for bundle in rows:
            own = np.frombuffer(bundle["_places"], "<u2")
            fresh = 1 - seen[own]
            seen[own] = 1
            if fresh.any():
                changed = True
                yield Row(_rows=bytes(bundle["_rows"]), _keep=fresh.tobytes())
        if changed:
            self._seen.update((packed(bytearray(np.packbits(seen, bitorder="little").tobytes())),))


def _bundle(key: str):
    """Rows without the copies a task met lately, bundled by the span of their key.

    Rows without a key are copies of one another and have a span of their own.
    """

    def bundled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        column = batch.column(key).cast(pa.int64())
        none, ids = column.is_null().to_numpy(False), column.fill_null(0).to_numpy()
        order = np.lexsort((ids, none))
        none, ids = none[order], ids[order]
        first = np.append(True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]))
        order, none, ids = order[first], none[first], ids[first]
        batch, spans = batch.take(pa.array(order)), ids >> _BITS
        own = (ids & (_SPAN - 1)).astype("<u2")
        ends = np.flatnonzero((spans[1:] != spans[:-1]) | (none[1:] != none[:-1])) + 1
        starts, ends = [0, *ends.tolist()], [*ends.tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["" if none[start] else str(spans[start]) for start in starts], pa.string()),
                pa.array([own[start:end].tobytes() for start, end in zip(starts, ends)], pa.binary()),
                pa.array(
                    [batch.slice(start, end - start).serialize().to_pybytes() for start, end in zip(starts, ends)],
                    pa.binary(),
                ),
            ],
            names=["_span", "_places", "_rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _BUNDLED:
                yield from bundled(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from bundled(pa.Table.from_batches(held))

    return run


def _unbundle(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        for batch in batches:
            for rows, keep in zip(batch.column("_rows"), batch.column("_keep")):  # one copied at a time
                mask = pa.array(np.frombuffer(keep.as_py(), np.uint8).astype(bool))
                yield pa.ipc.read_record_batch(pa.py_buffer(rows.as_py()), kind).filter(mask)

    return run


def _without_copies(key: str):
    """Rows whose key this task has not met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for batch in batches:
            if len(met) > _REMEMBERED:
                met = set()
            keep = []
            for value in batch.column(key).to_pylist():
                keep.append(value not in met)
                met.add(value)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def count_once(stream: DataFrame, key: str = "id") -> DataFrame:
    """ST2: the first row of each key, whenever its copies arrive.

    Copies that stand close together go where they are read, without any state, so
    a key with a third of all rows does not fill one task. The rest meets one
    lasting state. It has no watermark, so a late row is never dropped. Whole
    numbers are kept in an ``IdLedger``: about one bit for each id ever seen where
    ids are dense. Rows get there in bundles, as many as share a span, so that the
    state is asked once for each. Keys of other types are kept as they are.
    """
    schema = stream.schema
    if not isinstance(schema[key].dataType, _WHOLE):
        return stream.mapInArrow(_without_copies(key), schema).dropDuplicates([key])
    return (
        stream.mapInArrow(_bundle(key), _BUNDLE)
        .groupBy("_span")
        .transformWithState(IdLedger(), _KEPT, "Append", "None")
        .mapInArrow(_unbundle(schema), schema)
    )
