"""Learned operators and the pipeline against plain passes over each text."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_brute_force import plain_classes
from tidewatch.llm import decontamination, language_id, pii, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def of_fold(doc_id, folds):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds


def by_text(rows):
    """Sorted rows, as ids repeat and may be null."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(repr, r[1:])))


def logistic(x):
    return 1 / (1 + np.exp(-x))


# --- quality classifier ---------------------------------------------------------


def plain_quality(text, weights):
    """Passages of 64 words one after another; softmax of gated attention over them."""
    words = WORD.findall(text or "")
    encoded, raw = [], []
    for start in range(0, max(1, len(words)), 64):
        passage = words[start : start + 64]
        counts = np.zeros(len(weights["encode"]))
        for word in passage:
            for feature in quality_classifier.word_features(word.encode()):
                counts[feature] += 1
        state = np.tanh(np.sqrt(counts / max(1, len(passage))) @ weights["encode"] + weights["shift"])
        gated = np.tanh(state @ weights["tanh"]) * logistic(state @ weights["gate"])
        encoded.append(state)
        raw.append(gated @ weights["weigh"])
    share = np.exp(raw) / np.exp(raw).sum()
    return float(logistic(sum(s * e for s, e in zip(share, encoded)) @ weights["score"] + weights["bias"][0]))


def test_attention_scores(odd, odd_rows):
    model = quality_classifier.AttentionModel.fresh(quality_classifier.Training())
    found = [(r["doc_id"], r["text"], r["score"]) for r in quality_classifier.score(odd.select("doc_id", "text"), model).collect()]
    plain = [(i, text, plain_quality(text, model.weights)) for i, text in odd_rows]
    for got, wanted in zip(by_text(found), by_text(plain), strict=True):
        assert got[:2] == wanted[:2] and got[2] == pytest.approx(wanted[2], abs=1e-4)


def test_classified_documents(spark, corpus):
    """Scores of the fitted model, folds and cut."""
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(len(text) > 300)) for i, text in corpus], "doc_id bigint, quality int")
    setting = quality_classifier.Training(epochs=2)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_classifier.fit(docs, labels, ~held_out, setting)
    texts = dict(corpus)
    for row in quality_classifier.classify(docs, labels, setting).collect():
        score = plain_quality(texts[row["doc_id"]], model.weights)
        assert row["held_out"] == (of_fold(row["doc_id"], 5) == 0)
        assert row["score"] == pytest.approx(score, abs=1e-3)
        assert row["predicted"] == int(row["score"] >= 0.3)


# --- language -------------------------------------------------------------------


def plain_states(raw, weights, side):
    hidden = len(weights[f"new_{side}"])
    state, states = np.zeros(hidden), []
    for byte in raw if side == "f" else raw[::-1]:
        given = weights[f"in_{side}"][byte]
        gates = logistic(given[: 2 * hidden] + state @ weights[f"gate_{side}"])
        update, reset = gates[:hidden], gates[hidden:]
        new = np.tanh(given[2 * hidden :] + (reset * state) @ weights[f"new_{side}"])
        state = (1 - update) * state + update * new
        states.append(state)
    return states if side == "f" else states[::-1]


def plain_language(text, weights, languages):
    """A byte at a time; the mean over all positions of their distributions."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total, positions = np.zeros(len(languages)), 0
    for word in WORD.findall(text):
        raw = word.encode()
        for at in range(0, len(raw), language_id.PIECE_BYTES):
            part = raw[at : at + language_id.PIECE_BYTES]
            for ahead, behind in zip(plain_states(part, weights, "f"), plain_states(part, weights, "b")):
                scores = np.exp(ahead @ weights["out_f"] + behind @ weights["out_b"] + weights["bias"])
                total += scores / scores.sum()
                positions += 1
    pooled = total / positions
    return languages[int(pooled.argmax())], float(pooled.max())


def test_language_scores(odd, odd_rows):
    languages = ["aa", "bb", "cc"]
    network = language_id.ByteNetwork.fresh(16, len(languages), 3)
    short = [(i, text) for i, text in odd_rows if len(text or "") < 10_000]
    docs = odd.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) < 10_000)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, (languages, network)).collect()]
    plain = [(i, *plain_language(text, network.weights, languages)) for i, text in short]
    for got, wanted in zip(by_text(found), by_text(plain), strict=True):
        assert got[:2] == wanted[:2] and got[2] == pytest.approx(wanted[2], abs=1e-4)


# --- likelihood ratio -----------------------------------------------------------


def word_hash(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed=seed)


def plain_bins(text):
    words = [word_hash(w.encode()) for w in WORD.findall(text or "")]
    little = [w.to_bytes(8, "little") for w in words]
    pairs = [word_hash(b, word_hash(a)) for a, b in zip(little, little[1:])]
    return [h % quality_rules.BINS for h in words + pairs]


def plain_ratio_means(rows, labels):
    """Mean of each document, its own n-grams out of both counts."""
    grams = {i: plain_bins(text) for i, text in rows}
    raw, held = Counter(), Counter()
    for i, bins in grams.items():
        raw.update(bins)
        if labels.get(i) == 1:
            held.update(bins)
    all_raw, all_held = sum(raw.values()), sum(held.values())
    means = {}
    for i, bins in grams.items():
        own = Counter(bins)
        mine = own if labels.get(i) == 1 else Counter()
        share = (all_held - sum(mine.values())) / (all_raw - len(bins))
        logs = [
            n * math.log((held[b] - mine[b] + 3 * share) / (raw[b] - n + 3) / share) for b, n in own.items()
        ] if share else []
        means[i] = sum(logs) / len(bins) if logs else 0.0
    return means


def test_ratio_scores_and_verdicts(spark, corpus):
    labels = {i: i % 3 % 2 for i, _ in corpus if i % 4}
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels.items()], "doc_id bigint, quality int")
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, marks).collect()}
    means = plain_ratio_means(corpus, labels)
    judged = [(means[i], y) for i, y in labels.items() if not found[i]["base_failed"]]
    steps = sorted({math.floor(m * quality_rules.STEPS) for m, _ in judged})
    cuts = [quality_rules.LOWEST] + [(a + 1 + b) / (2 * quality_rules.STEPS) for a, b in zip(steps, steps[1:])]
    cut = min(cuts, key=lambda c: sum((m >= c) != (y == 1) for m, y in judged))
    for i, row in found.items():
        assert row["score"] == pytest.approx(means[i] - cut, abs=1e-6)
        assert row["kept"] == (not row["base_failed"] and row["score"] >= 0)


# --- pipeline -------------------------------------------------------------------


def test_whole_pipeline(spark, vocabulary):
    """Every stage of a run against plain passes, but for the benchmark stage, whose operator has tests of its own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    if not os.path.isdir(SF):
        pytest.skip("no given tables")
    docs, labels, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    model = quality_classifier.fit(docs, labels, F.lit(True))
    scores = {r["doc_id"]: plain_quality(r["text"], model.weights) for r in docs.collect()}
    assert min(abs(s - quality_classifier.CUT) for s in scores.values()) > 1e-3
    good = [(r["doc_id"], r["text"] or "") for r in docs.collect() if scores[r["doc_id"]] >= quality_classifier.CUT]
    classes = plain_classes(good)
    first = [(i, text) for i, text in good if classes[i][0] == i]
    kept = docs.where(F.col("doc_id").isin([i for i, _ in first]))
    clean = {r["doc_id"] for r in decontamination.remove_contaminated(kept, items).select("doc_id").collect()}
    library, cues = Tokenizer.from_file(vocabulary), pii.cue_automaton()
    plain = {}
    for i, text in first:
        if i in clean:
            redacted = pii.redacted(text, pii.find_spans(text, cues))
            ids = library.encode(redacted, add_special_tokens=False).ids
            plain[i] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    found = corpus_pipeline.run(spark, SF).collect()
    assert len(found) == len(plain) > 50
    assert {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["decoded"]) for r in found} == plain
