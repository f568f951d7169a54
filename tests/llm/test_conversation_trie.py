"""The trie against a plain one, and its parts: rebuilding, keys, sketch."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import conversation_trie as trie


def rebuilt_of(rows):
    """conv_id -> (role, text) turns, by the rule of the contract; ties by digest."""
    def digest(turn):
        role, text = turn
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn, (role or "", text or "")))
    for conv_id, some in own.items():
        some.sort(key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1])))
        own[conv_id] = [turn for _, turn in some]
    result = {}
    for conv_id, some in own.items():
        h = zlib.crc32(str(conv_id).encode()) % 9
        base = conv_id - int(np.fmod(conv_id, 5))
        result[conv_id] = own.get(base, [])[:h] + some[h:]
    return result


def plain(rows):
    paths = rebuilt_of(rows)
    members = {}
    for conv_id, turns in paths.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv_id)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) or 1
        own = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * own + sum(saved[c] for c in below)
    result = []
    for node, some in members.items():
        ends = sorted(c for c in some if len(paths[c]) == len(node))
        result.append(
            (
                min(some), len(node), min(members[node[:-1]]) if node else None, len(some), len(children.get(node, [])),
                leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(result, key=str)


def rows_of(spark, rows, slices=7):
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(slices)


def found(df):
    assert df.columns == trie._RESULT
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, convs=120, words=3, most=9):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(convs):
        if draw.random() < 0.1:
            continue
        for turn in range(draw.randint(1, most)):
            rows.append((conv_id, turn, draw.choice(["user", "assistant"]), draw.choice(["ä", "bb", "ccc"][:words])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_plain_one(spark, seed):
    rows = talk(seed)
    assert found(trie.prefix_trie(rows_of(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "user", "a"),
        (2, 5, "user", "only"), (2, 5, "user", "only"), (7, 1, "user", "x" * 300_000), (-3, 0, "user", "a"), (-3, 1, "u", "b"),
        (10, 1, "ser", "ux"), (15, 1, "seru", "x"), (20, 1, "ser", "ux"), (25, 1, "ser", "ux"), (30, 0, "ser", "ux"),
    ]
    assert found(trie.prefix_trie(rows_of(spark, rows))) == plain(rows)
    assert trie.prefix_trie(rows_of(spark, rows).limit(0)).collect() == []
    nobody = rows_of(spark, [(None, 1, "user", "a")])
    assert trie.prefix_trie(nobody).collect() == []


def test_turnless_conversations(spark):
    """Conversations that lose all their turns are members and ends of the root."""
    lost = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:6]
    rows = [(c, t, "user", "x") for c in lost for t in range(2)]
    result = found(trie.prefix_trie(rows_of(spark, rows)))
    assert result == plain(rows) and len(result) == 1


def test_long_conversation_over_many_tasks_and_a_full_sketch(spark, monkeypatch):
    """One conversation holds most rows, and its copy; a narrow sketch proves nothing."""
    rows = [(c, t, "user", f"{t % 7}") for c in (5, 10) for t in range(900)]
    rows += [(5, 900, "user", "end"), (6, 0, "user", "0"), *talk(3, 40)[:60]]
    rows = [*dict.fromkeys(rows)]
    df = rows_of(spark, rows, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = found(trie.prefix_trie(df))
        monkeypatch.setattr(trie, "may_be_shared", lambda bits, width, k1, k2: np.ones(len(k1), bool))
        unscreened = found(trie.prefix_trie(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert whole == unscreened == plain(rows)


def test_estimate_of_one_is_a_proof_and_tails_stay(spark):
    rows = talk(4, 200, most=12) + [(1000 + n, t, "user", f"{n}.{t}") for n in range(0, 300, 5) for t in range(12)]
    rebuilt, _ = trie.rebuild(rows_of(spark, rows))
    prefixes, carried = trie.keyed(rebuilt)
    carry = spark.sparkContext.broadcast(carried)
    bits, width = trie.sketch(prefixes, carry, prefixes.count())
    screen = trie._screen(carry, spark.sparkContext.broadcast(bits), width)
    screened = prefixes.mapInArrow(screen, trie._SCREENED_SQL)
    marked = screened.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n"), F.max("alone").alias("alone"))
    assert marked.where("alone AND n > 1").count() == 0
    # Nearly all of the 60 tails of own turns are proved, but for the first turn of each.
    assert marked.where("alone").count() > 0.95 * 60 * 11


def test_runs_of_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "_ENDS", 7)
    ids = [-5, *range(0, 2000, 3)]
    rows = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 9)], "depth long, k1 long, k2 long, conv_id long")
    result = {r["k2"]: r["ends_sha256"] for r in trie.end_digests(rows.repartition(6)).collect()}
    assert result == {
        3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        4: hashlib.sha256(b"9").hexdigest(),
    }


def test_clashing_columns(spark):
    rows = talk(9, 25)
    df = rows_of(spark, rows)
    for name in ("digest", "base", "h", "own", "total", "depth", "k1", "part", "position", "_row", "n_bytes", "start"):
        df = df.withColumn(name, F.lit("x"))
    assert found(trie.prefix_trie(df)) == plain(rows)
