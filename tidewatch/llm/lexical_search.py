"""Ranked lexical search of many items at once, sharing the sums they have in common.

A document's score for an item is a sum over the item's terms, and the summand of
a term does not depend on the item. Items that share terms therefore share sums:

1. ``matches`` reads every text once and keeps the counts of the items' terms
2. ``share_sums`` mines the term sets that several items hold: first terms that
   stand in just the same items, then, pair by pair, the two sums that most items
   still hold together. Each set is a node, made of terms and smaller nodes
3. every task evaluates the nodes for a batch of documents, each once, adds up
   the items from them, and keeps the best documents of each item
4. the best of all tasks meet, first in many groups an item, then per item

Items come in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` terms (an
item with more is a block of its own), which bounds what the driver mines and what
is broadcast. Every block searches all documents.

Defined results: a null or empty text has no term and is never found; rows with
equal item_ids are one item with the terms of all; an item without a known term
has no rows; documents with equal ids are ranked each for itself, and a null id
comes before all others of the same score; other columns are not used.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import pieces, texts_of
from tidewatch.sources.storage import store

BLOCK_ITEMS, BLOCK_TERMS = 1000, 50_000
#: Pairs are mined in items with at most this many sums left; others keep theirs apart.
_PAIRED = 300
#: Numbers in the table of sums of one batch.
_TABLE = 4_000_000
_PART = 1_000_000
#: Groups an item's candidates are first reduced in.
_GROUPS = 64

#: Bytes that end a term become spaces, A to Z small letters; all others stay.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def term_parts(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, with repeats, in parts of bounded size."""
    plain = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + _PART)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def share_sums(items: list[list[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """Sums that items share, and each item as a list of what is left to add.

    Numbers below ``n_terms`` are terms; the node at place ``i`` of the first list
    has the number ``n_terms + i`` and adds up smaller numbers.
    """
    held = defaultdict(list)
    for number, terms in enumerate(items):
        for term in sorted(set(terms)):
            held[term].append(number)
    together = defaultdict(list)
    for term, where in held.items():
        together[tuple(where)].append(term)
    nodes: list[list[int]] = []
    rest: list[set[int]] = [set() for _ in items]
    users: dict[int, set[int]] = {}
    for where, terms in sorted(together.items()):
        if len(where) > 1 and len(terms) > 1:
            nodes.append(terms)
            terms = [n_terms + len(nodes) - 1]
        for number in where:
            rest[number].update(terms)
        if len(where) > 1:
            users.update((term, set(where)) for term in terms)

    def shared(number: int) -> list[int]:
        return sorted(x for x in rest[number] if len(users.get(x, ())) > 1)

    mined = [shared(number) for number in range(len(items))]
    mined = [some if len(some) <= _PAIRED else [] for some in mined]
    open_items = {number for number, some in enumerate(mined) if some}
    pairs = Counter(pair for some in mined for pair in combinations(some, 2))
    queue = [(-count, pair) for pair, count in pairs.items() if count > 1]
    heapq.heapify(queue)
    while queue:
        count, pair = heapq.heappop(queue)
        both = users[pair[0]] & users[pair[1]] & open_items
        if len(both) < 2:
            continue
        if len(both) != -count:
            heapq.heappush(queue, (-len(both), pair))
            continue
        node = n_terms + len(nodes)
        nodes.append(list(pair))
        users[node] = set(both)
        met: Counter = Counter()
        for number in both:
            rest[number] -= set(pair)
            met.update(x for x in rest[number] if len(users.get(x, ())) > 1)
            rest[number].add(node)
        for old in pair:
            users[old] -= both
        for other, times in met.items():
            if times > 1:
                heapq.heappush(queue, (-times, (min(node, other), max(node, other))))
    return nodes, [sorted(some) for some in rest]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for item_id, text in zip(batch.column("item_id").to_pylist(), texts_of(batch)):
            terms = sorted(set().union(*term_parts(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([item_id] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"]
            )


def _count_terms(index):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in pieces(batches):
            sizes, places, times = [], [], []
            for text in texts_of(batch):
                n, found = 0, Counter()
                for part in term_parts(text):
                    n += len(part)
                    found.update([known[term] for term in part if term in known])
                sizes.append(n)
                places.append(list(found))
                times.append(list(found.values()))
            values = (batch.column("doc_id").to_pylist(), sizes, places, times)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def matches(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms with repeats, and place in ``index`` and count of each term that is there; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(_count_terms(sent), "doc_id bigint, n bigint, at array<int>, tf array<bigint>"), "matches")


class Search:
    """What tasks need to score documents: weights of terms, shared sums, items, and the corpus' size."""

    def __init__(self, weights: list[int], nodes: list[list[int]], tops: list[list[int]], docs: int, terms: int):
        self.weights = np.array(weights, np.int64)
        self.nodes = [np.array(node) for node in nodes]
        self.tops = [np.array(top, np.int64) for top in tops]
        self.docs, self.terms = docs, terms

    def scores(self, n: list[int], at: np.ndarray, tf: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Scores of each item (rows) for each document (columns); term ``at[i]`` stands ``tf[i]`` times in ``of[i]``."""
        lengths = np.array([10 + 90 * size * self.docs // self.terms for size in n], np.int64)
        table = np.zeros((len(self.weights) + len(self.nodes), len(n)), np.int64)
        table[at, of] = self.weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * lengths[of]))
        for number, node in enumerate(self.nodes, len(self.weights)):
            np.add.reduce(table[node], axis=0, out=table[number])
        return np.stack([np.add.reduce(table[top], axis=0) for top in self.tops])


def _first(found: tuple[int, int | None]) -> tuple:
    """Order of documents: higher scores, then no id, then smaller ids."""
    score, doc_id = found
    return (-score, doc_id is not None, doc_id or 0)


def _keep_best(search, k: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how: Search = search.value
        most = max(1, _TABLE // (len(how.weights) + len(how.nodes)))
        best: list[list] = [[] for _ in how.tops]
        least = np.ones(len(how.tops), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                counts = part.column("at").value_lengths().to_numpy(zero_copy_only=False)
                at = part.column("at").flatten().to_numpy()
                tf = part.column("tf").flatten().to_numpy()
                of = np.repeat(np.arange(part.num_rows), counts)
                ids = part.column("doc_id").to_pylist()
                scores = how.scores(part.column("n").to_pylist(), at, tf, of)
                # An equal score may still win by a smaller id.
                hits = scores >= least[:, None]
                for item in np.flatnonzero(hits.any(axis=1)).tolist():
                    new = np.flatnonzero(hits[item]).tolist()
                    found = [*best[item], *((int(scores[item, row]), ids[row]) for row in new)]
                    best[item] = sorted(found, key=_first)[:k]
                    if len(best[item]) == k:
                        least[item] = best[item][-1][0]
        rows = [(item, doc_id, score) for item, found in enumerate(best) for score, doc_id in found]
        group = TaskContext.get().partitionId() % _GROUPS
        values = [*zip(*rows)] if rows else [(), (), ()]
        arrays = [pa.array(v, f.type) for v, f in zip((*values, [group] * len(rows)), schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _search_block(docs: DataFrame, items: dict[int | None, list[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    index = {term: place for place, term in enumerate(sorted(set().union(*items.values())))}
    found = matches(docs, index)
    size = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = {row["at"]: row["df"] for row in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect()}
    weights = [
        math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * held.get(place, 0) + 1))) for place in range(len(index))
    ]
    nodes, tops = share_sums([[index[term] for term in terms] for terms in items.values()], len(index))
    sent = spark.sparkContext.broadcast(Search(weights, nodes, tops, size["docs"], max(size["terms"], 1)))
    kept = found.where(F.size("at") > 0).mapInArrow(_keep_best(sent, k), "item int, doc_id bigint, score bigint, at int")

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        by_score = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        return rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    best = ranked(ranked(kept, "item", "at").drop("rank"), "item")
    ids = F.lit([*items]).cast("array<bigint>")
    return best.select(F.get(ids, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    pairs = store(rows.mapInArrow(_item_terms, "item_id bigint, term binary").distinct(), "item-terms")
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n")).orderBy("item_id").collect()
    blocks: list[list] = []
    held = BLOCK_TERMS
    for row in sizes:
        if held + row["n"] > BLOCK_TERMS or len(blocks[-1]) >= BLOCK_ITEMS:
            blocks.append([])
            held = 0
        blocks[-1].append(row["item_id"])
        held += row["n"]
    results = []
    for block in blocks:
        ids = [i for i in block if i is not None]
        wanted = F.col("item_id").between(ids[0], ids[-1]) if ids else F.lit(False)
        if len(ids) < len(block):
            wanted = wanted | F.col("item_id").isNull()
        terms: dict[int | None, list[bytes]] = {}
        for row in pairs.where(wanted).orderBy("item_id", "term").collect():
            terms.setdefault(row["item_id"], []).append(bytes(row["term"]))
        results.append(_search_block(docs, terms, k))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, results)
