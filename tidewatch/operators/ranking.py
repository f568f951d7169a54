"""Positions in a total order without moving the data to one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.storage import store

# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33


def with_position(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in ``order_by`` order.

    Range partitions are sorted side by side and written once. Only their row
    counts, one number per shuffle partition, visit the driver; they become the
    offset of each partition. ``order_by`` should identify a row: then the
    result does not depend on the partitioning, and no run of equal keys can
    pile up in one range. Ranges are found from a sample, for which the last
    stage of ``df`` runs an extra time: hand in a stored table.
    """
    slots = store(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_slot", _ROW_BITS)
    counts = {
        row["part"]: row["rows"]
        for row in slots.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
    }
    offsets, total = [], 0
    for number in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(number, 0)
    start = F.get(F.lit(offsets or [0]).cast("array<bigint>"), part.cast("int"))
    row_in_part = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return slots.withColumn(name, start + row_in_part + 1).drop("_slot")
