"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded by the
frequencies of hashed word features (the word, its shape, its ending, its
signs), then by one dense layer. Gated attention weights the passages; the
weighted sum gives the score. All weights, the attention included, are learned
from document labels alone, in numpy.

Training takes a bounded sample: at most ``train_docs`` labelled documents,
chosen by a hash; documents above ``most_words`` words are left out of training.
Where doc_ids repeat, at most twice as many rows are kept, also by a hash. Scoring
covers every passage of every text and whole words.

Defined results: a null or empty text is one passage without features and gets
the score of that; without usable labels all scores are 0.5; of several labels
of one document the largest counts and null labels do not; equal rows give equal
rows; doc_id, lang, source and labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from tidewatch.llm.shared import fold, pieces, split_words, texts_of

PASSAGE_WORDS = 64
#: Bins of hashed features, and features of a word.
BINS, _FEATURES = 512, 6


@dataclass(frozen=True)
class Training:
    train_docs: int = 3000
    most_words: int = 60_000
    encoded: int = 24
    attention: int = 12
    epochs: int = 14
    bag_batch: int = 64
    rate: float = 0.01
    seed: int = 11


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits by one sign each; other signs stay."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def word_features(raw: bytes) -> list[int]:
    word = raw.decode("utf-8", "replace")
    form = shape(word)
    size = len(word)
    length = f"n{size if size < 16 else size.bit_length() + 12}"
    signs = "".join(sorted({c for c in form if c not in "Aa0"}))
    texts = (f"w{word}", f"s{form}", f"e{word[-3:]}", f"t{form[:1]}{form[-1:]}", length, f"p{signs}")
    return [crc32(text.encode()) % BINS for text in texts]


class _Features:
    """Feature rows by word; forgotten when there are too many."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.reset()

    def reset(self):
        self.row: dict[bytes, int] = {}
        self.rows = np.zeros((1024, _FEATURES), np.int16)

    def add(self, words: list[bytes]) -> None:
        start = len(self.row)
        while len(self.rows) < start + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for n, word in enumerate(words, start):
            self.row[word] = n
            self.rows[n] = word_features(word)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature frequencies of all passages, and the number of passages of each text."""
        split = [split_words(text) for text in texts]
        held = set().union(*split)
        if len(self.row) + len(held.difference(self.row)) > self.limit:
            self.reset()
        self.add(list(held.difference(self.row)))
        sizes = np.array([len(words) for words in split])
        bags = np.maximum(1, -(-sizes // PASSAGE_WORDS))
        first = np.concatenate([[0], np.cumsum(bags)])
        every = chain.from_iterable(split)
        words = np.fromiter(map(self.row.__getitem__, every), np.int64, int(sizes.sum()))
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = np.repeat(first[:-1], sizes) + within // PASSAGE_WORDS
        at = passage[:, None] * BINS + self.rows[words]
        counts = np.bincount(at.ravel(), minlength=int(first[-1]) * BINS).reshape(-1, BINS)
        held = np.bincount(passage, minlength=int(first[-1]))
        return np.sqrt(counts / np.maximum(held, 1)[:, None]).astype(np.float32), bags


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class AttentionModel:
    """Dense encoder, gated attention, logistic score."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, setting: Training) -> AttentionModel:
        draw = np.random.default_rng(setting.seed)
        wide, deep = setting.encoded, setting.attention
        made = {
            "encode": draw.normal(0, 0.2, (BINS, wide)),
            "shift": np.zeros(wide),
            "tanh": draw.normal(0, 0.3, (wide, deep)),
            "gate": draw.normal(0, 0.3, (wide, deep)),
            "weigh": draw.normal(0, 0.3, deep),
            "score": draw.normal(0, 0.3, wide),
            "bias": np.zeros(1),
        }
        return cls({name: value.astype(np.float32) for name, value in made.items()})

    def forward(self, passages: np.ndarray, bags: np.ndarray):
        w = self.weights
        first = np.cumsum(bags) - bags
        encoded = np.tanh(passages @ w["encode"] + w["shift"])
        turned, gate = np.tanh(encoded @ w["tanh"]), _sigmoid(encoded @ w["gate"])
        raw = (turned * gate) @ w["weigh"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), bags))
        weight = raw / np.repeat(np.add.reduceat(raw, first), bags)
        pooled = np.add.reduceat(encoded * weight[:, None], first, axis=0)
        score = _sigmoid(pooled @ w["score"] + w["bias"][0])
        return score, (encoded, turned, gate, weight, pooled, first)

    def gradients(self, passages: np.ndarray, bags: np.ndarray, labels: np.ndarray):
        w = self.weights
        score, (encoded, turned, gate, weight, pooled, first) = self.forward(passages, bags)
        error = (score - labels) / len(labels)
        to_pooled = np.repeat(error, bags)[:, None] * w["score"]
        to_encoded = to_pooled * weight[:, None]
        to_weight = (to_pooled * encoded).sum(1)
        to_raw = weight * (to_weight - np.repeat(np.add.reduceat(weight * to_weight, first), bags))
        both = to_raw[:, None] * w["weigh"]
        to_turned = both * gate * (1 - turned * turned)
        to_gate = both * turned * gate * (1 - gate)
        to_encoded = to_encoded + to_turned @ w["tanh"].T + to_gate @ w["gate"].T
        to_dense = to_encoded * (1 - encoded * encoded)
        return {
            "encode": passages.T @ to_dense,
            "shift": to_dense.sum(0),
            "tanh": encoded.T @ to_turned,
            "gate": encoded.T @ to_gate,
            "weigh": to_raw @ (turned * gate),
            "score": pooled.T @ error,
            "bias": error.sum(keepdims=True),
        }


def train_model(bags: list[tuple[np.ndarray, int]], setting: Training) -> AttentionModel:
    """Adam over batches of whole bags."""
    model = AttentionModel.fresh(setting)
    draw = np.random.default_rng(setting.seed)
    first = {name: np.zeros_like(value) for name, value in model.weights.items()}
    second = {name: np.zeros_like(value) for name, value in model.weights.items()}
    batches = -(-len(bags) // setting.bag_batch)
    step, last = 0, setting.epochs * batches
    for _ in range(setting.epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(bags), setting.bag_batch):
            some = [bags[i] for i in order[at : at + setting.bag_batch]]
            step += 1
            rate = setting.rate * (1 - 0.9 * step / last)
            passages = np.concatenate([b for b, _ in some]).astype(np.float32)
            sizes = np.array([len(b) for b, _ in some])
            slopes = model.gradients(passages, sizes, np.array([y for _, y in some], np.float32))
            for name, slope in slopes.items():
                first[name] += 0.1 * (slope - first[name])
                second[name] += 0.001 * (slope * slope - second[name])
                size = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-7)
                model.weights[name] -= (rate * size).astype(np.float32)
    return model


def _bags(schema: pa.Schema, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in pieces(batches):
            passages, bags = features.of(texts_of(batch))
            ends = np.cumsum(bags)
            fits = bags * PASSAGE_WORDS <= most_words
            raw = [
                passages[end - size : end].astype("<f2").tobytes() if fit else None
                for end, size, fit in zip(ends, bags, fits)
            ]
            labels = batch.column("label")
            made = pa.RecordBatch.from_arrays([labels, pa.array(raw, pa.binary())], schema=schema)
            yield made.filter(pa.array(fits))

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, setting: Training = Training()) -> AttentionModel | None:
    """Train on labels of rows where ``learn`` holds; the result does not depend on row order."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn)
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(setting.seed), "doc_id"), "doc_id")
        .limit(setting.train_docs)
    )
    # train_docs rows of two numbers bound the broadcast side.
    texts = docs.select("doc_id", "text").where(learn).join(F.broadcast(chosen), "doc_id")
    schema = pa.schema([("label", pa.int32()), ("bag", pa.binary())])
    made = texts.mapInArrow(_bags(schema, setting.most_words), "label int, bag binary")
    # Repeated doc_ids must not widen the sample: at most two rows a document on average, chosen by hash.
    rows = made.orderBy(F.xxhash64(F.lit(setting.seed), "bag", "label"), "bag", "label").limit(2 * setting.train_docs)
    samples = sorted((bytes(r["bag"]), r["label"]) for r in rows.collect())
    if not samples:
        return None
    bags = [(np.frombuffer(raw, "<f2").reshape(-1, BINS), label) for raw, label in samples]
    return train_model(bags, setting)


def _scored(model: AttentionModel | None, name: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in pieces(batches, most=1_000_000):
            if model:
                scores = model.forward(*features.of(texts_of(batch)))[0].astype(float)
            else:
                scores = np.full(batch.num_rows, 0.5)
            arrays = [pa.array(scores) if f.name == name else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def score(docs: DataFrame, model: AttentionModel | None, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a column of that name is replaced."""
    kept = docs.drop(name)
    out = StructType([*kept.schema]).add(name, DoubleType())
    return kept.mapInArrow(_scored(model, name, to_arrow_schema(out)), out)


#: Score from which a document is predicted to be of quality 1.
CUT = 0.3


def classify(docs: DataFrame, labels: DataFrame, setting: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 of 5 are held out from training."""
    held_out = fold("doc_id", 5) == 0
    model = fit(docs, labels, ~held_out, setting)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
