import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.streaming.ids import _SPAN, _bundle
from tidewatch.streaming.monitor import _HANDED, use_disk_state


def test_copies_that_stand_close_are_not_bundled():
    """Copies of a hundred ids and rows without an id, in batches of their own: one row each, by span."""
    ids = [None, *range(4050, 4150)]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": [n] * 101}) for n in range(50)]
    (out,) = _bundle("id")(iter(batches))
    kept = {}
    for span, places, rows in zip(*(column.to_pylist() for column in out.columns)):
        rows = pa.ipc.read_record_batch(pa.py_buffer(rows), batches[0].schema)
        assert set(rows.column("n").to_pylist()) == {0}
        assert span not in kept
        kept[span] = rows.column("id").to_pylist()
        assert np.frombuffer(places, "<u2").tolist() == [(i or 0) % _SPAN for i in kept[span]]
    assert kept == {"": [None], "0": [*range(4050, 4096)], "1": [*range(4096, 4150)]}


def test_tasks_are_handed_few_bundles(spark, tmp_path):
    """What a task of Python holds at once does not grow with the rows of its partition."""
    use_disk_state(spark)
    rows = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), F.lit(1 << 20)).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).mapInArrow(sizes, "bytes bigint")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(
        availableNow=True
    ).start(str(tmp_path / "out")).awaitTermination()
    largest = spark.read.parquet(str(tmp_path / "out")).agg(F.max("bytes")).first()[0]
    assert largest <= _HANDED + (2 << 20)
