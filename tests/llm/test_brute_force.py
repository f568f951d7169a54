"""Operators against plain versions of themselves on small corpora."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import (
    bpe,
    components,
    decontamination,
    jaccard_join,
    language_id,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_output,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- personal data --------------------------------------------------------------


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("0123456789. -", max_size=40), st.text("ab0@.+-% é", max_size=30), st.text("01 -+().", max_size=40)))
def test_base_spans(text):
    assert [s for s in pii.find_spans(text, pii.cue_automaton()) if s[1] < 4] == plain_spans(text)


def test_further_kinds_and_redaction():
    cues = pii.cue_automaton()
    text = "See https://user:secret@host.example/x and IBAN DE89 3704 0044 0532 0130 00, SSN 078-05-1120. Fine: https://a.example"
    spans = pii.find_spans(text, cues)
    kinds = [pii.KINDS[kind] for _, kind, _ in spans]
    assert {"login", "iban", "national"} <= set(kinds) and kinds.count("login") == 1
    assert pii.redacted(text, spans) == "See [LOGIN]/x and IBAN [IBAN], SSN [NATIONAL]. Fine: https://a.example"
    assert pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 and plain prose, SSN pending", cues) == []


def test_counts_and_digest(spark):
    text = "x a@b.example 10.0.0.1, 4111 1111 1111 1111, +44 20 7946 0958"
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    spans = pii.written(plain_spans(text))
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["spans"] == spans and row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


# --- near duplicates ------------------------------------------------------------


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    sets = {i: shingles(text) for i, text in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block_bytes", [2_000_000, 3_000])
def test_near_duplicates(documents, corpus, block_bytes):
    """Small blocks compare a group in many tasks and find the same."""
    setting = jaccard_join.Setting(block_bytes=block_bytes)
    found = jaccard_join.near_duplicates(documents, setting).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == plain_classes(corpus)


def test_weak_ties_go_by_bands(spark, monkeypatch):
    """A long chain of weakly similar texts is one group; its sets travel by band, and no link is lost."""
    draw = random.Random(3)
    words = [f"w{n}" for n in range(6_000)]
    rows = []
    for n in range(150):
        text = words[n * 18 : n * 18 + 90 + 5 * (n % 4)]
        rows.append((2 * n, " ".join(text)))
        if n % 3 == 0:
            text[draw.randrange(len(text))] = "changed"
            rows.append((2 * n + 1, " ".join(text)))
    placed = []
    plain = jaccard_join.placements

    def seen(*given):
        placed.append(plain(*given))
        return placed[-1]

    monkeypatch.setattr(jaccard_join, "placements", seen)
    setting = jaccard_join.Setting(block_bytes=4_000, bands=60, rows=4)
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), setting).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == plain_classes(rows)
    units = [unit for r in placed[0].collect() for unit in r["units"]]
    assert any(unit["banded"] for unit in units)


def test_pairs_of_a_band_only():
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 30, (80, 3)) + np.array([0, 100, 200])
    lefts, rights = np.arange(0, 50), np.arange(30, 80)
    found = {(i, j) for i, js in jaccard_join._sharing(keys, lefts, rights) for j in js.tolist()}
    plain = {(i, j) for i in lefts.tolist() for j in rights.tolist() if i != j and (keys[i] == keys[j]).any()}
    assert found == plain


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_link_of_the_table(spark, size):
    """Recall against an exact join of all documents: no link and no class differs."""
    directory = f"/root/testdata/{size}"
    if not os.path.isdir(directory):
        pytest.skip("no given tables")
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == plain_classes(rows)


def test_large_near_group_makes_few_rows(spark):
    words = [f"w{n}" for n in range(300)]
    rows = [(n, " ".join([*words[:n], "x", *words[n + 1 :]])) for n in range(120)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r["class_id"], r["n_links"]) for r in found.collect()} == {(0, 119)}


def test_posterior_table():
    setting = jaccard_join.Setting()
    for n, least in jaccard_join.least_matches(setting):
        p = np.linspace(0, 1, 20_001)
        density = p ** (least - 1) * (1 - p) ** (n - least + 1) if least else None
        if density is not None:
            assert density[p >= 0.8].sum() / density.sum() < 10 * setting.tolerance


def test_components(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100 + n, 100) for n in range(1, 30)] + [(7, 3), (3, 7)]
    found = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(n, 0) for n in range(1, 41)} | {(100 + n, 100) for n in range(1, 30)}


# --- passages -------------------------------------------------------------------


def plain_kept(rows):
    words = {i: WORD.findall(text) for i, text in rows}
    first = {}
    for i in sorted(words):
        for at in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][at : at + 13]), i)
    kept = {}
    for i, some in words.items():
        gone = set()
        for at in range(len(some) - 12):
            if first[tuple(some[at : at + 13])] < i:
                gone |= set(range(at, at + 13))
        kept[i] = " ".join(w for n, w in enumerate(some) if n not in gone)
    return kept


def test_repeated_passages(documents, corpus):
    found = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(documents).collect()}
    assert found == plain_kept(corpus)


def test_wavelet_ranks():
    draw = np.random.default_rng(3)
    sequence = draw.integers(0, 37, 1000)
    matrix = substring_dedup.WaveletMatrix(sequence, 37)
    symbol, at = draw.integers(0, 37, 400), draw.integers(0, 1001, 400)
    assert matrix.rank(symbol, at).tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbol, at)]


def test_index_search():
    """Intervals of the search hold each window as often as the text does, and its smallest value."""
    draw = np.random.default_rng(8)
    passages = [draw.integers(1, 4, 20) for _ in range(3)]
    parts = [np.concatenate([draw.integers(1, 4, 14), passages[n % 3], [0]]) for n in range(40)]
    text = np.concatenate(parts)
    size = np.array([len(part) - 1 for part in parts])
    first = np.cumsum(size + 1) - size - 1
    values = draw.integers(0, 1000, len(text))
    index = substring_dedup.FMIndex(text, 4, values)
    plain = {}
    for at in range(len(text) - 12):
        plain.setdefault(tuple(text[at : at + 13].tolist()), []).append(at)
    seen = 0
    for at, low, high in index.window_matches(text, first, size):
        least = index.least(low, high)
        for place, many, value in zip(at.tolist(), (high - low).tolist(), least.tolist()):
            places = plain[tuple(text[place : place + 13].tolist())]
            assert (many, value) == (len(places), min(values[p] for p in places))
            seen += 1
    assert seen == int((size - 12).sum())


# --- language and quality --------------------------------------------------------


def test_gradients_of_byte_network():
    network = language_id.ByteNetwork.fresh(3, 2, 1)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    data, wanted = np.array([[1, 2, 1], [5, 2, 9]], np.uint8), np.array([0, 1])

    def loss():
        found = network.positions(data)[0]
        return -np.mean([np.log(found[n, :, c]) for n, c in enumerate(wanted)])

    slopes = network.gradients(data, wanted)
    for name, place in (("in_f", (2, 1)), ("in_b", (9, 7)), ("gate_f", (0, 4)), ("new_b", (1, 2)), ("out_b", (2, 0)), ("bias", (1,))):
        value = network.weights[name][place]
        network.weights[name][place] = value + 1e-5
        high = loss()
        network.weights[name][place] = value - 1e-5
        low = loss()
        network.weights[name][place] = value
        assert slopes[name][place] == pytest.approx((high - low) / 2e-5, rel=0.02, abs=1e-6)


def test_gradients_of_attention():
    setting = quality_classifier.Training(encoded=4, attention=3)
    model = quality_classifier.AttentionModel.fresh(setting)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    passages = np.random.default_rng(2).random((5, quality_classifier.BINS))
    bags, labels = np.array([2, 3]), np.array([1.0, 0.0])

    def loss():
        score = model.forward(passages, bags)[0]
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    slopes = model.gradients(passages, bags, labels)
    for name, place in (("encode", (3, 1)), ("tanh", (2, 1)), ("gate", (0, 2)), ("weigh", (1,)), ("score", (3,)), ("bias", (0,))):
        value = model.weights[name][place]
        model.weights[name][place] = value + 1e-5
        high = loss()
        model.weights[name][place] = value - 1e-5
        low = loss()
        model.weights[name][place] = value
        assert slopes[name][place] == pytest.approx((high - low) / 2e-5, rel=0.02, abs=1e-7)


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given_tables(spark):
    pytest.importorskip("duckdb")
    if not __import__("os").path.exists(SF):
        pytest.skip("no test tables")
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def test_held_out_language(given_tables):
    docs = given_tables("documents")
    found = language_id.identify_languages(docs).where("held_out").join(docs, "doc_id").select("lang", "lang_pred")
    rows = found.collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_held_out_quality(given_tables):
    found = quality_classifier.classify(given_tables("documents"), given_tables("labels"))
    rows = found.where("held_out").join(given_tables("labels"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def plain_rules(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {at + k for at, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_rules(spark, given_tables):
    odd = [(0, "a b c a b c\n\n \na b c\na b c\x0b"), (1, "a  a a a <#>|é \r\n x \r"), (2, "\n\n"), (3, " \x1c\x85 ")]
    docs = given_tables("documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in odd], docs.schema))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = given_tables("labels")
    rows = quality_rules.apply_rules(docs, labels).collect()
    for r in rows:
        base = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert base == plain_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(quality[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.97


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_rules_at_every_size(spark, size):
    """Labels of a fold are withheld; verdicts on them, and the share dropped, do not go with the table's size."""
    if not __import__("os").path.exists(f"/root/testdata/{size}"):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{name}.parquet") for name in ("documents", "labels"))
    withheld = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    rows = quality_rules.apply_rules(docs, labels.where(~withheld)).where("NOT base_failed").collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    apart = {r["doc_id"] for r in labels.where(withheld).collect()}
    good = [r["kept"] for r in rows if r["doc_id"] in apart and quality[r["doc_id"]] == 1]
    assert np.mean(good) > 0.93
    dropped = np.mean([not r["kept"] for r in rows if r["doc_id"] not in quality])
    assert dropped < 0.2
    if size != "sf0.001":  # there a handful of bad labels sets the cut, and most bad documents are kept
        assert 0.05 < dropped
        assert np.mean([r["kept"] for r in rows if r["doc_id"] in apart and quality[r["doc_id"]] == 0]) < 0.35


def test_own_words_do_not_count(spark):
    shared = " ".join(f"w{n % 40}x{n}" for n in range(60))
    texts = [(1, shared + " a"), (2, shared + " b"), (3, " ".join(f"alone{n}" for n in range(60)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    one = spark.createDataFrame([(3, 1)], "doc_id bigint, quality int")
    three = {r["doc_id"]: r["score"] for r in quality_rules.apply_rules(docs, one).collect()}
    assert three[3] == -quality_rules.LOWEST  # no other document is trusted
    judged = [(0.5, 1), (0.4, 1), (-0.2, 0), (-0.6, 1), (-0.9, 0), (-0.9, 0)]
    frame = spark.createDataFrame(judged, "mean double, quality int")
    assert abs(quality_rules.best_cut(frame).first()["cut"] + 0.75) < 0.01
    assert quality_rules.best_cut(frame.where("quality = 0")).first()["cut"] == quality_rules.LOWEST


# --- tokens ---------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_automaton_equals_library(text):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    automaton = bpe.compile_automaton(path).ready()
    library = Tokenizer.from_file(path)
    splitter = automaton.splitter
    ids = [i for p in splitter.pieces(text) for w in splitter.words(p) for i in automaton.encode_word(w)]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_coded_documents(documents, corpus, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    texts = dict(corpus)
    for row in bpe.digests(bpe.encode_decode(documents, vocabulary)).collect():
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_files(documents, corpus, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    found = {r["doc_id"]: r for r in token_output.token_files(documents, vocabulary).collect()}
    start = 0
    for i, text in sorted(corpus):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


@given(st.lists(st.integers(0, 5000), max_size=1200))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(steps)
    coded = token_output.EliasFano.of(values)
    assert [coded.select(n) for n in range(len(values))] == values.tolist()
    for n in range(0, len(values), 37):
        assert coded.select(n) == values[n]
    if len(values) > 200:
        bits = 8 * (len(coded.low) + len(coded.high))
        assert bits <= len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 16


# --- decontamination --------------------------------------------------------------


def test_reparameterised_items(spark):
    item = "Tom has 3 apples and 5 pears and walks 12 km to the market where Tom sells all of them to Ann"
    other = "Bob has 7 apples and 9 pears and walks 40 km to the market where Bob sells all of them to Eve"
    mixed = "Bob has 7 apples and 9 pears and walks 40 km to the market where Sue sells all of them to Eve"
    merged = "Bob has 7 apples and 9 pears and walks 40 km to the market where Bob sells all of them to Bob"
    texts = [f"before it all {item} after", f"before it all {other} after", f"well {mixed} so", f"well {merged} so"]
    texts += ["Tom has 3 apples and nothing else to say about the market at all", "PREFIX, " + other.replace(" and ", " and, ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, "short item of six plain words")], "item_id bigint, text string")
    found = decontamination.contamination(docs, items).where("contaminated").collect()
    assert {r["doc_id"]: r["item_ids"] for r in found} == {0: [7], 1: [7], 5: [7]}
    kept = decontamination.remove_contaminated(docs, items).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 4]


def test_whole_items_are_found(given_tables):
    squeezed = lambda text: " ".join(text.split())
    docs = {r["doc_id"]: squeezed(r["text"]) for r in given_tables("documents").collect()}
    items = {r["item_id"]: squeezed(r["text"]) for r in given_tables("benchmark").collect()}
    wanted = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    found = decontamination.contamination(given_tables("documents"), given_tables("benchmark")).collect()
    assert {(r["doc_id"], i) for r in found for i in r["item_ids"]} == wanted


# --- sharding ---------------------------------------------------------------------


def test_shards(documents, corpus):
    rows = {r["doc_id"]: r for r in sharding.shard_documents(documents).collect()}
    texts = dict(corpus)
    for i, r in rows.items():
        raw = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows.values() if r["shard"] == shard) == list(
            range(sum(r["shard"] == shard for r in rows.values()))
        )


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(20_000)
    tree = sharding.uniform_tree()
    heavier = tuple(s if s.shard != 5 else sharding.Shard(s.region, s.rack, s.shard, 2.0) for s in tree)
    rows = keys.select(
        sharding.place(keys["id"], tree).alias("a"), sharding.place(keys["id"], heavier).alias("b")
    ).collect()
    region = {s.shard: s.region for s in tree}
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(region[b] == region[5] for _, b in moved)
    share = np.bincount([r["b"] for r in rows], minlength=16) / len(rows)
    assert abs(share[5] - 2 / 17) < 0.02
