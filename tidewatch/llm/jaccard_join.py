"""Near-duplicate join on five-word shingles with Bayesian candidate pruning.

1. Each text becomes the set of its 64-bit shingle hashes, 240 MinHash values in
   40 bands of 6, and a 128-bit key of the set. Texts with one key are copies;
   they are counted and go on as one.
2. Sets that share a band are candidates; a pair of similarity 0.8 shares none
   with probability 5e-6. Ties to the smallest set of each band make groups.
3. Only sets in groups of two or more are built again. They travel by unit: a
   whole group, or each of their shared bands where that moves less, as for weak
   ties that run through a corpus. A unit is cut into blocks of bounded size, and a task compares the pairs of two blocks
   that share a band (of several band units, in that of the first one only):
   MinHash values in steps of 16, after each of which pairs go whose posterior
   probability of reaching the threshold (uniform prior) is below the
   tolerance. What is left is verified exactly on the sets.
4. A task returns the links of each set and edges that span what it linked,
   never its pairs, so a group of g texts gives rows in proportion to g.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a text of one to
four words is one shingle; null texts and texts without a word link to nothing
and are classes of their own; rows with a repeated doc_id count as documents of
their own; the class is named by its smallest doc_id (null only if all are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.shared import Memo, free_name, grouped, pieces, split_words, texts_of
from tidewatch.sources.storage import store

SHINGLE = 5


@dataclass(frozen=True)
class Setting:
    threshold: float = 0.8
    bands: int = 40
    rows: int = 6
    tolerance: float = 1e-8
    step: int = 16
    block_bytes: int = 2_000_000


def least_matches(setting: Setting) -> list[tuple[int, int]]:
    """After n compared values: the fewest matches that keep a pair.

    With a uniform prior the posterior of the similarity after m of n matches is
    Beta(m + 1, n - m + 1); its mass above t is P(Binomial(n + 1, t) <= m).
    """
    table, total = [], setting.bands * setting.rows
    for n in range(setting.step, total + 1, setting.step):
        mass, m = 0.0, -1
        while mass < setting.tolerance:
            m += 1
            mass += math.comb(n + 1, m) * setting.threshold**m * (1 - setting.threshold) ** (n + 1 - m)
        table.append((n, m))
    return table


class Shingler:
    """Shingle sets, MinHash values and keys of texts."""

    def __init__(self, setting: Setting):
        self._words = Memo(xxhash.xxh64_intdigest)
        draw = np.random.default_rng(20240501)
        count = setting.bands * setting.rows
        self._factor = draw.integers(0, 1 << 32, (count, 1), np.uint32) | np.uint32(1)
        self._shift = draw.integers(0, 1 << 32, (count, 1), np.uint32)
        self._setting = setting

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        split = [split_words(text) for text in texts]
        sizes = np.array([len(words) for words in split])
        flat = np.fromiter(
            map(self._words.__getitem__, (w for words in split for w in words)), np.uint64, int(sizes.sum())
        )
        padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
        rolled = np.zeros(len(flat), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(flat)]
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
        ends = np.cumsum(sizes)
        found = []
        for size, end in zip(sizes.tolist(), ends.tolist()):
            if size >= SHINGLE:
                found.append(np.unique(rolled[end - size : end - SHINGLE + 1]))
            elif size:
                whole = xxhash.xxh64_intdigest(flat[end - size : end].tobytes())
                found.append(np.array([whole], np.uint64))
            else:
                found.append(np.zeros(0, np.uint64))
        return found

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """MinHash values."""
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self._factor), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            some = low[at : at + 1024] * self._factor
            some += self._shift
            np.minimum(least, some.min(axis=1), out=least)
        return least

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        rows = values.reshape(self._setting.bands, self._setting.rows).astype(np.uint64)
        key = np.arange(1, self._setting.bands + 1, dtype=np.uint64)
        for k in range(self._setting.rows):
            key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("key", pa.binary()),
        ("node", pa.int64()),
        ("n_set", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def _sign(setting: Setting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(setting)
        for batch in pieces(batches, most=1_000_000):
            sets = shingler.sets(texts_of(batch))
            keys = [set_key(s) for s in sets]
            bands = [shingler.band_keys(shingler.values(s)) if len(s) else None for s in sets]
            arrays = [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(keys, pa.binary()),
                pa.array([int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SIGNED)

    return run


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")


_SETS = pa.schema(
    [
        ("banded", pa.bool_()),
        ("unit", pa.int64()),
        ("a", pa.int32()),
        ("b", pa.int32()),
        ("block", pa.int32()),
        ("key", pa.binary()),
        ("copies", pa.int64()),
        ("shingles", pa.binary()),
    ]
)


def _build_sets(setting: Setting):
    """In each of its units, a set goes once to each pair of blocks that its own block is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(setting)
        for batch in pieces(batches, most=1_000_000):
            columns = [batch.column(n).to_pylist() for n in ("units", "key", "copies")]
            out: list[list] = [[] for _ in _SETS]
            held = 0
            for shingles, (units, key, copies) in zip(shingler.sets(texts_of(batch)), zip(*columns)):
                raw = shingles.tobytes()
                for place in units:
                    block = place["block"]
                    for other in range(place["blocks"]):
                        pair = min(block, other), max(block, other)
                        row = (place["banded"], place["unit"], *pair, block, key, copies, raw)
                        for values, value in zip(out, row):
                            values.append(value)
                        held += len(raw)
                        if held > 8_000_000:
                            made = [pa.array(v, f.type) for v, f in zip(out, _SETS)]
                            yield pa.RecordBatch.from_arrays(made, schema=_SETS)
                            out, held = [[] for _ in _SETS], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _SETS)], schema=_SETS)

    return run


def _sharing(keys: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row with the right rows that have one of its band keys; row by row to bound memory.

    Band keys differ between bands, so equal keys are equal bands.
    """
    every, inverse = np.unique(keys, return_inverse=True)
    inverse = inverse.reshape(keys.shape)
    held = inverse[rights]
    order = np.argsort(held, axis=None, kind="stable")
    members = np.repeat(rights, keys.shape[1])[order]
    ends = np.cumsum(np.bincount(held.ravel(), minlength=len(every)))
    starts = np.concatenate([[0], ends[:-1]])
    met = np.zeros(len(keys), bool)
    for i in lefts.tolist():
        bands = inverse[i]
        for start, end in zip(starts[bands].tolist(), ends[bands].tolist()):
            met[members[start:end]] = True
        met[i] = False
        js = np.flatnonzero(met)
        met[js] = False
        if len(js):
            yield i, js


def _candidates(
    values: np.ndarray, keys: np.ndarray, sizes: np.ndarray, block: np.ndarray, task: tuple, setting: Setting, table
):
    """Pairs of one band that survive the incremental comparison.

    A pair of several band units is compared in that of its first common band.
    """
    banded, unit, a, b = task
    lefts, rights = np.flatnonzero(block == a), np.flatnonzero(block == b)
    for i, js in _sharing(keys, lefts, rights):
        if a == b:
            js = js[js > i]
        if banded:
            first = (keys[js] == keys[i]).argmax(axis=1)
            js = js[keys[i][first] == unit]
        small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
        js = js[small >= setting.threshold * large - 1e-9]
        same = np.zeros(len(js), np.int32)
        done = 0
        for n, least in table:
            if not len(js):
                break
            same += (values[js, done:n] == values[i, done:n]).sum(axis=1, dtype=np.int32)
            keep = same >= least
            js, same, done = js[keep], same[keep], n
        if len(js):
            yield i, js


_LINKED = pa.schema([("node", pa.int64()), ("key", pa.binary()), ("links", pa.int64()), ("tied", pa.int64())])


def _verify(setting: Setting):
    def node(key: bytes) -> int:
        return int.from_bytes(key[:8], "little", signed=True)

    def linked(task, rows: list[dict], shingler: Shingler, table):
        rows = list({row["key"]: row for row in rows}.values())
        if len(rows) < 2:
            return
        sets = [np.frombuffer(row["shingles"], np.uint64) for row in rows]
        sizes = np.array([len(s) for s in sets])
        values = np.stack([shingler.values(s) for s in sets])
        keys = np.stack([shingler.band_keys(v) for v in values])
        block = np.array([row["block"] for row in rows])
        copies = np.array([row["copies"] for row in rows])
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        flag = np.zeros(len(every), bool)
        links = np.zeros(len(rows), np.int64)
        root = list(range(len(rows)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in _candidates(values, keys, sizes, block, task, setting, table):
            own = inverse[ends[i] - sizes[i] : ends[i]]
            flag[own] = True
            shared = np.array([int(np.count_nonzero(flag[inverse[ends[j] - sizes[j] : ends[j]]])) for j in js.tolist()])
            flag[own] = False
            true = js[shared >= setting.threshold * (sizes[i] + sizes[js] - shared) - 1e-9]
            links[i] += copies[true].sum()
            links[true] += copies[i]
            for j in true.tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        for n in np.flatnonzero(links).tolist():
            yield node(rows[n]["key"]), rows[n]["key"], int(links[n]), node(rows[find(n)]["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(setting), least_matches(setting)
        out: list[tuple] = []
        for key, rows in grouped(batches, ("banded", "unit", "a", "b")):
            out += linked(key, rows, shingler, table)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _LINKED)], schema=_LINKED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _LINKED)], schema=_LINKED)

    return run


def _in_blocks(sets: DataFrame, setting: Setting, *unit: str) -> DataFrame:
    """Units of two or more sets, with their ``bytes`` in a task and the ``blocks`` these make."""
    size = F.col("n_set") * 8 + 4 * setting.bands * setting.rows
    sums = sets.groupBy(*unit).agg(F.count("*").alias("sets"), F.sum(size).alias("bytes"))
    blocks = F.ceil(F.col("bytes") / setting.block_bytes).cast("int")
    return sums.where("sets > 1").select(*unit, "bytes", blocks.alias("blocks"))


def placements(chosen: DataFrame, held: DataFrame, setting: Setting) -> DataFrame:
    """Key, copies and first document of each set with its ``units``.

    ``chosen`` has a row for each set and its group, ``held`` one for each set
    and band that another set shares. A group of several blocks goes by bands
    if that moves fewer bytes: a set meets each block of its unit once.
    """
    kept = ["key", "copies", "first"]
    by_group = _in_blocks(chosen, setting, "group")
    several = by_group.where("blocks > 1")
    banded = held.select("node", "band").join(
        chosen.join(several.select("group"), "group", "left_semi"), "node"
    )
    by_band = _in_blocks(banded, setting, "band", "group")
    moved = by_band.groupBy("group").agg(F.sum(F.col("bytes") * F.col("blocks")).alias("moved"))
    cheaper = store(
        moved.join(several, "group").where(F.col("moved") < F.col("bytes") * F.col("blocks")).select("group"), "banded"
    )

    def place(by_bands: bool, unit: str) -> Column:
        return F.struct(
            F.lit(by_bands).alias("banded"),
            F.col(unit).alias("unit"),
            F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
            "blocks",
        )

    whole = chosen.join(by_group, "group").join(cheaper, "group", "left_anti")
    split = banded.join(cheaper, "group", "left_semi").join(by_band.drop("group"), "band")
    # At most as many units as bands.
    units = split.groupBy(*kept).agg(F.collect_list(place(True, "band")).alias("units"))
    return whole.select(*kept, F.array(place(False, "group")).alias("units")).union(units.select(*kept, "units"))


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, text_key, class_node, class_id, n_links, n_copies of every row.

    ``n_links`` counts other documents of similarity 0.8 or more, copies included.
    """
    signed_sql = "doc_id bigint, text_key bigint, key binary, node bigint, n_set bigint, bands array<bigint>"
    signed = store(_identified(docs).mapInArrow(_sign(setting), signed_sql), "signatures")
    with_words = signed.where(F.col("key").isNotNull())

    # Copies become one row before their bands move.
    classes = store(
        with_words.groupBy("key", "node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"),
            F.count("*").alias("copies"),
            F.max("n_set").alias("n_set"),
            F.any_value("bands").alias("bands"),
        ),
        "classes",
    )

    # Candidate groups: bands held by two sets tie them to the smallest.
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most")
    held = store(bands.join(shared.select("band", "v"), "band"), "shared-bands")
    groups = components(held.where("node > v").select(F.col("node").alias("u"), "v"))
    members = groups.select("node", F.col("root").alias("group")).union(
        groups.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()
    )

    # One document of each set in a group, and blocks of bounded size.
    chosen = store(classes.drop("bands").join(members, "node"), "members")
    placed = placements(chosen, held, setting).select(
        F.coalesce(F.col("first.doc_id"), F.lit(-(1 << 63))).alias("id_key"),
        F.col("first.text_key").alias("text_key"),
        "key",
        "copies",
        "units",
    )
    texts = _identified(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id_key"), "text_key", "text"
    )
    task = ("banded", "unit", "a", "b")
    sets_sql = "banded boolean, unit bigint, a int, b int, block int, key binary, copies bigint, shingles binary"
    sets = texts.join(placed, ["id_key", "text_key"]).select("text", "key", "copies", "units").mapInArrow(
        _build_sets(setting), sets_sql
    )
    tasks = sets.repartition(*task).sortWithinPartitions(*task)
    linked = store(tasks.mapInArrow(_verify(setting), "node bigint, key binary, links bigint, tied bigint"), "links")

    # Classes: groups of what was verified, named by their smallest doc_id.
    roots = components(linked.select(F.col("node").alias("u"), F.col("tied").alias("v")))
    named = classes.select("key", "node", F.col("first.doc_id").alias("doc_id"), "copies").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    info = named.join(names, "root").join(links, "key", "left").select(
        "key", "class_id", F.col("root").alias("class_node"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "text_key", "key").join(info, "key", "left").select(
        "doc_id",
        "text_key",
        "class_node",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def keep_first(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """One row of each class with all its columns: the one with the smallest doc_id.

    Rows without words stay. Null doc_ids come last; of texts with one doc_id the
    one with the smaller hash stays, of equal rows one.
    """
    ids, texts = free_name("_class_doc_id", docs), free_name("_class_text_key", docs)
    nothing = F.lit(-(1 << 63))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = (
        near_duplicates(docs, setting)
        .where(F.col("class_node").isNotNull())
        .groupBy("class_node")
        .agg(F.min(order).alias("first"))
        .select(F.coalesce("first.doc_id", nothing).alias(ids), F.col("first.text_key").alias(texts))
        .distinct()
    )
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns({ids: F.coalesce(F.col("doc_id").cast("long"), nothing), texts: text_key()})
    kept = keyed.join(first, [ids, texts]).dropDuplicates([ids, texts])
    return kept.select(docs.columns).union(docs.where(~worded))
