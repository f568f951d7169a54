"""Prefix trie of rebuilt conversations, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations
that start with it, its owner is the smallest of them.

1. Turns become digests; texts are read once and never move. Positions within a
   conversation come from one global order, so a long conversation is spread.
2. The key of a prefix is the sum of hashes of its turns with their places, in two
   lanes of 64 bits. Sums run along the sorted rows, and one number per task
   carries a conversation over the border of two tasks.
3. All keys are counted in a count-min sketch. An estimate of one proves that a
   prefix belongs to one conversation, and so does every longer one: such tails are
   emitted where they stand. Only prefixes that may be shared, and the first turn
   after one, are shuffled.
4. These are grouped exactly. Members own the nodes of the end of their path, from
   the first depth on where they are the smallest member. Hence all numbers of a
   subtree are sums over the members of its top, and no level waits for another:
   savings are the texts that a member reads before its own nodes, leaves are
   the members that own a childless end, children the members that own the next node.

The sketch has counters of two bits in two rows of up to ``WIDEST`` each, about
eight for each prefix. Beyond that it proves less, more prefixes are grouped
exactly, and the result is the same.

Defined results: rows without conv_id belong to no conversation; null turns come
first; rows of equal turn follow one another by the digest of role and text; null
role or text is empty; repeated rows are turns of their own; ``c-c%5`` is taken
with the sign rule of SQL; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import grouped
from tidewatch.operators.ranking import with_position
from tidewatch.sources.storage import store

#: The rule that rebuilds conversations: groups of ids, and remainders of the head's length.
GROUP, HEADS = 5, 9
#: Counters in a row of the sketch: least, most, and for each prefix.
NARROWEST, WIDEST, PER_PREFIX = 1 << 16, 1 << 26, 8
_CHUNK = 1 << 16
#: Ids of ends that are joined into one text.
_ENDS = 50_000


# --- turns ------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and bytes of each turn; stored."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return store(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, 16).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "turns",
    )


def head_size(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rebuilt turns ``conv_id, depth, total, digest, n_bytes``, and every conversation with its ``total``."""
    placed = with_position(turns(conversations), ["conv_id", "turn", "digest", "_row"])
    lengths = placed.groupBy("conv_id").agg(F.min("position").alias("start"), F.count("*").alias("own"))
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    known = lengths.select("*", base, head_size(F.col("conv_id")).alias("h"))
    given = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = store(
        known.join(given, "base", "left")
        .withColumn("taken", taken)
        .withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .drop("base_own"),
        "conversations",
    )
    rows = placed.join(convs, "conv_id").withColumn("place", F.col("position") - F.col("start") + 1)
    own = rows.where(F.col("place") > F.col("h")).withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    heads = rows.where((F.col("conv_id") == F.col("base")) & (F.col("place") < HEADS))
    takers = convs.select("conv_id", "base", "h", "total")
    lent = (
        heads.select("base", F.col("place").alias("depth"), "digest", "n_bytes")
        .join(takers, "base")
        .where(F.col("depth") <= F.col("h"))
    )
    columns = ["conv_id", "depth", "total", "digest", "n_bytes"]
    return store(own.select(columns).unionByName(lent.select(columns)), "rebuilt"), convs.select("conv_id", "total")


# --- keys of prefixes -------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit (splitmix64; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_values(digests: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn (16 bytes) at its depth."""
    lanes = digests.view("<u8").reshape(-1, 2)
    place = _mixed(depths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mixed(lanes[:, 0] + place), _mixed(lanes[:, 1] ^ place)


def _running(values: np.ndarray, starts: np.ndarray, carried) -> np.ndarray:
    """Sums from the start of each run on; the first run goes on from ``carried``. Wraps around."""
    sums = np.cumsum(values, dtype=values.dtype)
    before = np.where(starts > 0, sums[starts - 1], np.zeros(1, values.dtype))
    before[starts == 0] -= np.array([carried]).astype(values.dtype)
    return sums - np.repeat(before, np.diff(np.append(starts, len(values))))


_KEYED = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "depth", "total", "v1", "v2", "k1", "k2", "n_bytes", "after", "at")]
    + [("part", pa.int32())]
)
_KEYED_SQL = ", ".join(f"{f.name} {'int' if f.name == 'part' else 'bigint'}" for f in _KEYED)


def _sum_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values and running sums of rows sorted by conversation and depth, within one task."""
    part, at = TaskContext.get().partitionId(), 0
    last, carried = None, (0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, n_bytes = (batch.column(n).to_numpy() for n in ("conv_id", "depth", "n_bytes"))
        digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8)
        v1, v2 = turn_values(digests, depth)
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        if conv[0] != last:
            carried = (0, 0, 0)
        k1, k2, after = (_running(v, starts, c) for v, c in zip((v1, v2, n_bytes), carried))
        last, carried = conv[-1], (k1[-1], k2[-1], after[-1])
        values = (conv, depth, batch.column("total"), v1, v2, k1, k2, n_bytes, after)
        arrays = [v if isinstance(v, pa.Array) else pa.array(v.view(np.int64)) for v in values]
        arrays += [pa.array(np.arange(at, at + len(conv))), pa.array(np.full(len(conv), part, np.int32))]
        at += len(conv)
        yield pa.RecordBatch.from_arrays(arrays, schema=_KEYED)


def keyed(rebuilt: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Stored rows with sums within their task, and what each task carries over from those before it."""
    ordered = rebuilt.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    rows = store(
        ordered.select("conv_id", "depth", "total", "digest", "n_bytes").mapInArrow(_sum_along, _KEYED_SQL), "prefixes"
    )
    ends = [F.max_by(name, "at").alias(name) for name in ("k1", "k2", "after")]
    # One row for each task.
    found = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), *ends)
    parts = {row["part"]: row for row in found.collect()}
    size = max(parts, default=-1) + 1
    carry = {name: np.zeros(size, np.int64) for name in ("first", "k1", "k2", "after")} | {"goes_on": np.zeros(size, bool)}
    last, held = None, (0, 0, 0)
    for number in sorted(parts):
        row = parts[number]
        goes_on = last is not None and row["first"] == last
        carry["first"][number], carry["goes_on"][number] = row["first"], goes_on
        if goes_on:
            for name, value in zip(("k1", "k2", "after"), held):
                carry[name][number] = np.array([value % 2**64], np.uint64).view(np.int64)[0]
        whole = goes_on and row["first"] == row["last"]
        held = tuple(row[name] + (value if whole else 0) for name, value in zip(("k1", "k2", "after"), held))
        last = row["last"]
    return rows, carry


def _finished(batch: pa.RecordBatch, carry: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns of a batch with sums from the start of each conversation."""
    rows = {name: batch.column(name).to_numpy() for name in batch.schema.names}
    part = rows["part"]
    over = carry["goes_on"][part] & (rows["conv_id"] == carry["first"][part])
    for name in ("k1", "k2", "after"):
        rows[name] = rows[name] + np.where(over, carry[name][part], 0)
    return rows


# --- screening --------------------------------------------------------------------------


def _places(keys: np.ndarray, width: int) -> np.ndarray:
    return keys & (width - 1)


def _count_min(carry, width: int):
    """Counters 0, 1 and more of the prefixes of a task, as two bits in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, width), np.uint8)
        for batch in batches:
            rows = _finished(batch, carry.value)
            for lane, name in enumerate(("k1", "k2")):
                places, times = np.unique(_places(rows[name], width), return_counts=True)
                counters[lane, places] = np.minimum(counters[lane, places] + np.minimum(times, 2), 2)
        for number, chunk in enumerate(counters.reshape(-1, _CHUNK)):
            if chunk.any():
                bits = np.packbits(chunk > 0).tobytes() + np.packbits(chunk > 1).tobytes()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int32()), "bits": [bits]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which counters of a chunk are more than one in the sum of all tasks; chunks arrive sorted."""
    schema = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
    current, seen, more = None, None, None
    for batch in batches:
        for chunk, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
            some, many = np.frombuffer(bits, np.uint8).reshape(2, -1)
            if chunk != current:
                if current is not None:
                    yield pa.RecordBatch.from_pydict({"chunk": [current], "bits": [more.tobytes()]}, schema)
                current, seen, more = chunk, some, many
            else:
                more = more | many | (seen & some)
                seen = seen | some
    if current is not None:
        yield pa.RecordBatch.from_pydict({"chunk": [current], "bits": [more.tobytes()]}, schema)


def sketch(rows: DataFrame, carry, prefixes: int) -> tuple[np.ndarray, int]:
    """Bits of the counters above one, and the width of a row; at most ``WIDEST`` bits a row reach the driver."""
    width = NARROWEST
    while width < min(PER_PREFIX * prefixes, WIDEST):
        width *= 2
    kinds = "chunk int, bits binary"
    counted = rows.select("conv_id", "k1", "k2", "after", "part").mapInArrow(_count_min(carry, width), kinds)
    merged = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge, kinds)
    bits = np.zeros((2 * width // _CHUNK, _CHUNK // 8), np.uint8)
    for row in merged.collect():
        bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(2, -1), width


def may_be_shared(bits: np.ndarray, width: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Prefixes whose estimate is above one: all of their counters are."""
    shared = np.ones(len(k1), bool)
    for row, keys in zip(bits, (k1, k2)):
        at = _places(keys, width)
        shared &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return shared


_SCREENED = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "depth", "total", "k1", "k2", "n_bytes", "after")] + [("alone", pa.bool_())]
)
_SCREENED_SQL = ", ".join(f"{f.name} {'boolean' if f.name == 'alone' else 'bigint'}" for f in _SCREENED)


def _screen(carry, found, width: int):
    """Rows with finished keys, marked if both they and their parent belong to one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _finished(batch, carry.value)
            parent1, parent2 = rows["k1"] - rows["v1"], rows["k2"] - rows["v2"]
            # The root is shared by all.
            below = (rows["depth"] == 1) | may_be_shared(found.value, width, parent1, parent2)
            alone = ~(below | may_be_shared(found.value, width, rows["k1"], rows["k2"]))
            values = [pa.array(rows[f.name], f.type) for f in _SCREENED if f.name != "alone"]
            yield pa.RecordBatch.from_arrays([*values, pa.array(alone)], schema=_SCREENED)

    return run


# --- nodes ------------------------------------------------------------------------------

_NODE = ["depth", "k1", "k2"]


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, comma-joined, from sorted rows."""
    schema = pa.schema([(n, pa.int64()) for n in (*_NODE, "first")] + [("ids", pa.string())])

    def packed(key, ids) -> list:
        return [*key, ids[0], ",".join(map(str, ids))]

    rows: list[list] = []
    key, ids = None, []
    for batch in batches:
        for *node, conv_id in zip(*(batch.column(n).to_pylist() for n in (*_NODE, "conv_id"))):
            if node != key or len(ids) >= _ENDS:
                if ids:
                    rows.append(packed(key, ids))
                key, ids = node, []
            ids.append(conv_id)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if ids:
        rows.append(packed(key, ids))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of all ids of a node, run by run as they arrive sorted."""
    schema = pa.schema([(n, pa.int64()) for n in _NODE] + [("ends_sha256", pa.string())])
    key, digest, rows = None, None, []
    for batch in batches:
        for *node, ids in zip(*(batch.column(n).to_pylist() for n in (*_NODE, "ids"))):
            if node == key:
                digest.update(b",")
            else:
                if key is not None:
                    rows.append([*key, digest.hexdigest()])
                key, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if key is not None:
        rows.append([*key, digest.hexdigest()])
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conv_ids of each node, ascending and comma-joined.

    Ids are sorted and joined by range, so the ids of one node are spread; what one
    task then hashes in order is a row for every ``_ENDS`` of them.
    """
    nodes = "depth bigint, k1 bigint, k2 bigint, "
    runs = (
        ends.repartitionByRange(*_NODE, "conv_id")
        .sortWithinPartitions(*_NODE, "conv_id")
        .mapInArrow(_join_ids, nodes + "first bigint, ids string")
    )
    return (
        runs.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").drop("first").mapInArrow(_hash_ids, nodes + "ends_sha256 string")
    )


_RESULT = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def _tails(screened: DataFrame) -> DataFrame:
    """Nodes of one conversation below another such node."""
    own_id = F.when(F.col("depth") == F.col("total"), F.col("conv_id").cast("string")).otherwise("")
    return screened.where("alone").select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("total")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(own_id.cast("binary"), 256).alias("ends_sha256"),
    )


def _members(rows: DataFrame, root: int) -> DataFrame:
    """Where the own nodes of each conversation start, who owns the node before, its text so far, and its leaf."""
    ends_here = F.col("depth") == F.col("total")
    # Stored, so that the rows of a node that very many share are a side of the join that Spark can split.
    nodes = store(
        rows.groupBy(*_NODE).agg(
            F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.count_if(ends_here).alias("n_ends")
        ),
        "nodes",
    )
    own = F.col("owner") == F.col("conv_id")
    foreign = F.when(~own, F.col("depth"))
    leaf = own & ((F.col("n") == 1) | (ends_here & (F.col("n") == F.col("n_ends"))))
    return (
        rows.join(nodes, _NODE)
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.min(F.when(own, F.col("depth"))), F.max("total") + 1).alias("own_from"),
            F.coalesce(F.max_by("owner", foreign), F.lit(root)).alias("above"),
            F.coalesce(F.max_by("after", foreign), F.lit(0)).alias("read"),
            F.max(leaf.cast("int")).alias("leaf"),
        )
    )


def _numbers() -> list[Column]:
    """Numbers of a node as sums over its members."""
    depth, own_from = F.col("depth"), F.col("own_from")
    before = F.col("after") - F.col("n_bytes")
    parent = F.when(own_from < depth, F.col("conv_id")).when(own_from == depth, F.col("above"))
    return [
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((own_from <= depth + 1) & (depth < F.col("total"))).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(depth < own_from, F.col("read") - before).otherwise(0)).alias("saved_tokens"),
    ]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: owner, depth, owner of the parent, members, children, leaves, savings and ends."""
    spark = conversations.sparkSession
    rebuilt, convs = rebuild(conversations)
    whole = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n")).first()
    if not whole["n"]:
        kinds = ", ".join(f"{name} {'string' if name == 'ends_sha256' else 'bigint'}" for name in _RESULT)
        return spark.createDataFrame([], kinds)
    rows, carried = keyed(rebuilt)
    carry = spark.sparkContext.broadcast(carried)
    bits, width = sketch(rows, carry, rows.count())
    found = spark.sparkContext.broadcast(bits)
    screened = store(rows.mapInArrow(_screen(carry, found, width), _SCREENED_SQL), "screened")

    shared = screened.where(~F.col("alone")).drop("alone")
    members = store(_members(shared, whole["first"]), "members")
    silent = convs.where(F.col("total") == 0).select(*[F.lit(0).cast("long").alias(n) for n in _NODE], "conv_id")
    ends = shared.where(F.col("depth") == F.col("total")).select(*_NODE, "conv_id").unionByName(silent)
    of_root = members.agg(
        F.count_if(F.col("own_from") == 1).alias("n_children"),
        F.greatest(F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("read"), F.lit(0)).alias("saved_tokens"),
    ).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        F.lit(whole["first"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
    )
    nodes = shared.join(members, "conv_id").groupBy(*_NODE).agg(*_numbers()).unionByName(of_root)
    none = hashlib.sha256(b"").hexdigest()
    hashed = nodes.join(end_digests(store(ends, "ends")), _NODE, "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(none))
    )
    return hashed.select(_RESULT).unionByName(_tails(screened).select(_RESULT))
