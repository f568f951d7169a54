"""Placement of documents by a hierarchical weighted hash tree.

Leaves are shards; racks hold shards and regions hold racks. A document descends
from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` a
hash of the document's key and the child's name, and the smallest draw wins. A
child's weight is the sum of the shards below it. A change of weights therefore
moves documents only between a changed subtree and the others: the draws of all
other children stay as they are.

``grow`` opens a region and a rack for the new shard, so no old subtree changes
its weight and documents move into the new shard only.

Defined results: a null key counts as the empty text; a null text has size 1 and
crc32 0; equal rows get neighbouring slots; an empty table gives no rows; other
columns of the input are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranking import with_position

#: 13 hex digits of a digest: 52 bits, exact in a double.
_DIGITS, _SPAN = 13, float(1 << 52)


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(regions: int = 4, racks: int = 2, shards: int = 2) -> tuple[Shard, ...]:
    """Numbered shards with equal weights in equal racks and regions."""
    per_region = racks * shards
    return tuple(
        Shard(n // per_region, n // shards % racks, n) for n in range(regions * per_region)
    )


def grow(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region and rack of its own."""
    region = max((s.region for s in tree), default=-1) + 1
    number = max((s.shard for s in tree), default=-1) + 1
    return (*tree, Shard(region, 0, number, weight))


def children(tree: tuple[Shard, ...], level: str) -> dict[int, tuple[Shard, ...]]:
    found: dict[int, list[Shard]] = {}
    for shard in tree:
        found.setdefault(getattr(shard, level), []).append(shard)
    return {name: tuple(found[name]) for name in sorted(found)}


def _winner(key: Column, where: str, below: dict[int, tuple[Shard, ...]]) -> Column:
    """The child with the smallest weighted draw; the smaller number on a tie."""
    if len(below) == 1:
        return F.lit(next(iter(below)))
    draws = []
    for name, leaves in below.items():
        digest = F.md5(F.concat(key, F.lit(f"|{where}{name}")))
        u = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / _SPAN
        weight = float(sum(leaf.weight for leaf in leaves))
        draws.append(F.struct((-F.ln(u) / weight).alias("draw"), F.lit(name).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def place(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of each key."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def chosen(picked: Column, below: dict[int, tuple[Shard, ...]], inner) -> Column:
        cases = None
        for name, leaves in below.items():
            value = inner(name, leaves)
            cases = F.when(picked == name, value) if cases is None else cases.when(picked == name, value)
        return cases

    def in_rack(region: int):
        def pick(rack: int, leaves: tuple[Shard, ...]) -> Column:
            return _winner(text, f"s{region}.{rack}.", children(leaves, "shard"))

        return pick

    def in_region(region: int, leaves: tuple[Shard, ...]) -> Column:
        racks = children(leaves, "rack")
        return chosen(_winner(text, f"k{region}.", racks), racks, in_rack(region))

    regions = children(tree, "region")
    return chosen(_winner(text, "r", regions), regions, in_region)


def shard_documents(docs: DataFrame, tree: tuple[Shard, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one growth.

    Only fixed-size columns are shuffled. Slots are positions in the order of
    shard and doc_id less the first position of the shard, so a large shard is
    numbered by many tasks.
    """
    tree = tree or uniform_tree()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), tree).cast("int").alias("shard"),
        place(F.col("doc_id"), grow(tree)).cast("int").alias("grown_shard"),
        # Equal rows are told apart by where they stand in the input.
        F.monotonically_increasing_id().alias("_row"),
    )
    numbered = with_position(rows, ["shard", "doc_id", "text_crc32", "size", "_row"], "_position")
    # One row for each shard of the tree.
    firsts = {
        row["shard"]: row["first"]
        for row in numbered.groupBy("shard").agg(F.min("_position").alias("first")).collect()
    }
    starts = [firsts.get(number, 0) for number in range(max((s.shard for s in tree)) + 1)]
    slot = F.col("_position") - F.get(F.lit(starts).cast("array<bigint>"), F.col("shard"))
    return numbered.select(
        "doc_id", "size", "text_crc32", "law", "shard", slot.alias("slot"), "grown_shard"
    )
