"""Shared sums, terms and the ranking against a plain version."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(documents, items, k=10):
    split = [(doc_id, terms_of(text)) for doc_id, text in documents]
    docs = sum(bool(terms) for _, terms in split)
    total = sum(len(terms) for _, terms in split)
    held = {}
    for _, terms in split:
        for term in set(terms):
            held[term] = held.get(term, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, df in held.items()}
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms_of(text))
    rows = []
    for item_id, terms in wanted.items():
        scored = []
        for doc_id, own in split:
            m = 10 + (90 * len(own) * docs) // max(total, 1)
            score = sum(
                weight[t] * (10**9 * own.count(t) // (1000 * own.count(t) + 8 * m)) for t in terms & set(own)
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, some, doc_id) in enumerate(sorted(scored)[:k], 1):
            rows.append((item_id, rank, doc_id if some else None, -score))
    return rows


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@given(st.text(max_size=80))
def test_terms(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for part in lexical_search.term_parts(text) for t in part] == terms_of(text)


def test_parts_of_a_long_text(monkeypatch):
    text = "Über 20 Äpfel, x-ray; " * 50
    monkeypatch.setattr(lexical_search, "_PART", 7)
    parts = [*lexical_search.term_parts(text)]
    assert len(parts) > 50 and [t.decode() for part in parts for t in part] == terms_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), max_size=12), max_size=9))
def test_items_are_the_sums_of_their_shared_sets(items):
    nodes, tops = lexical_search.share_sums(items, 15)
    sets = [[term] for term in range(15)]
    for node in nodes:
        assert len(node) > 1 and max(node) < len(sets)
        sets.append(sorted(term for part in node for term in sets[part]))
    for item, top in zip(items, tops):
        assert sorted(term for part in top for term in sets[part]) == sorted(set(item))
    used = [part for some in [*nodes, *tops] for part in some]
    for number in range(15, len(sets)):
        assert used.count(number) > 1 or any(number in node for node in nodes)


def test_sharing_saves_additions():
    draw = random.Random(2)
    common = [draw.sample(range(200), 12) for _ in range(5)]
    items = [draw.choice(common) + draw.choice(common) + draw.sample(range(200, 900), 6) for _ in range(100)]
    nodes, tops = lexical_search.share_sums(items, 900)
    additions = sum(len(some) - 1 for some in [*nodes, *tops])
    assert additions < 0.5 * sum(len(set(item)) - 1 for item in items)


@pytest.mark.parametrize("limits", [(1000, 50_000, 4_000_000), (2, 50_000, 300), (1000, 9, 50)])
def test_ranking_equals_the_plain_one(spark, corpus, odd, odd_rows, monkeypatch, limits):
    for name, value in zip(("BLOCK_ITEMS", "BLOCK_TERMS", "_TABLE"), limits):
        monkeypatch.setattr(lexical_search, name, value)
    documents = [*corpus, *odd_rows, (500, corpus[3][1]), (500, corpus[3][1]), (499, corpus[3][1]), (None, corpus[3][1])]
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(5)
    items = [(n, " ".join(text.split()[:14])) for n, (_, text) in enumerate(corpus[:12])]
    items += [(3, "the QUICK w1 brown-fox"), (90, None), (91, "nowhere"), (None, "The fox, the dog, ΑΣ straße"), (3, "w1")]
    rows = spark.createDataFrame(items, "item_id bigint, text string")
    assert in_order(lexical_search.search(docs, rows).collect()) == in_order(plain(documents, items))


def test_no_rows(spark, nothing, documents):
    items = spark.createDataFrame([(1, "the of")], "item_id bigint, text string")
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(documents, items.limit(0)).count() == 0


def test_clashing_columns(spark, odd):
    items = odd.selectExpr("doc_id AS item_id", "text", "n_chars AS rank", "lang AS score", "source AS at", "lang AS n")
    assert lexical_search.search(odd.withColumnsRenamed({"score": "n", "at": "tf"}), items).count() > 0
