"""Language by a bidirectional gated recurrent network over bytes.

A sequence is a word (long words: pieces of 48 bytes). Two gated recurrent
layers read its bytes forward and backward; each byte position gets a
distribution over the languages. A document's distribution is the mean over all
positions of all its words. Because a sequence is a word, equal words are read
once per task and counted by table look-up after that.

The network is trained in numpy by backpropagation through time, on the words of
a bounded sample of labelled documents: at most ``docs_per_language`` documents
of each language in expectation and at most ``train_words`` words, both chosen
by hashes. Prediction covers every word of every text.

Defined results: ``und`` with score 0 for a null text or one without a letter,
and for all texts if no labelled row may be learned from; ties go to the
language first in the alphabet; equal rows give equal rows; other columns are
never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from tidewatch.llm.shared import fold, pieces, split_words, texts_of

PIECE_BYTES = 48
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    docs_per_language: int = 200
    train_words: int = 60_000
    hidden: int = 16
    steps: int = 900
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteNetwork:
    """Weights and both passes. Inputs are byte matrices, one row for each sequence of one length."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, hidden: int, classes: int, seed: int) -> ByteNetwork:
        draw = np.random.default_rng(seed)
        made = {}
        for side in "fb":
            made[f"in_{side}"] = draw.normal(0, 0.3, (256, 3 * hidden))
            made[f"gate_{side}"] = draw.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            made[f"new_{side}"] = draw.normal(0, hidden**-0.5, (hidden, hidden))
            made[f"out_{side}"] = draw.normal(0, hidden**-0.5, (hidden, classes))
        made["bias"] = np.zeros(classes)
        return cls({name: value.astype(np.float32) for name, value in made.items()})

    def _read(self, side: str, data: np.ndarray):
        """States after each byte and what the way back needs, in reading order."""
        w = self.weights
        hidden = w[f"new_{side}"].shape[0]
        state = np.zeros((len(data), hidden), np.float32)
        steps = []
        for t in range(data.shape[1]):
            given = w[f"in_{side}"][data[:, t]]
            gates = _sigmoid(given[:, : 2 * hidden] + state @ w[f"gate_{side}"])
            update, reset = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(given[:, 2 * hidden :] + (reset * state) @ w[f"new_{side}"])
            steps.append((state, update, reset, new))
            state = state + update * (new - state)
        return steps, [s[0] for s in steps[1:]] + [state]

    def positions(self, data: np.ndarray):
        """Distribution at each position: sequences x length x classes."""
        w = self.weights
        forward, ahead = self._read("f", data)
        backward, behind = self._read("b", data[:, ::-1])
        ahead, behind = np.stack(ahead, 1), np.stack(behind[::-1], 1)
        scores = ahead @ w["out_f"] + behind @ w["out_b"] + w["bias"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True), (forward, backward, ahead, behind)

    def gradients(self, data: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions, by backpropagation through time."""
        w = self.weights
        found, (forward, backward, ahead, behind) = self.positions(data)
        error = found
        error[np.arange(len(data)), :, wanted] -= 1
        error /= error.shape[0] * error.shape[1]
        flat = error.reshape(-1, error.shape[2])
        hidden = ahead.shape[2]
        out = {
            "bias": flat.sum(0),
            "out_f": ahead.reshape(-1, hidden).T @ flat,
            "out_b": behind.reshape(-1, hidden).T @ flat,
        }
        sides = (("f", forward, data, error), ("b", backward, data[:, ::-1], error[:, ::-1]))
        for side, steps, read, errors in sides:
            into = np.zeros_like(w[f"in_{side}"])
            gate, fresh = np.zeros_like(w[f"gate_{side}"]), np.zeros_like(w[f"new_{side}"])
            carried = np.zeros_like(steps[0][0])
            for t in range(len(steps) - 1, -1, -1):
                state, update, reset, new = steps[t]
                carried = carried + errors[:, t] @ w[f"out_{side}"].T
                to_new = carried * update * (1 - new * new)
                to_update = carried * (new - state) * update * (1 - update)
                through = to_new @ w[f"new_{side}"].T
                to_reset = through * state * reset * (1 - reset)
                to_gates = np.concatenate([to_update, to_reset], axis=1)
                gate += state.T @ to_gates
                fresh += (reset * state).T @ to_new
                np.add.at(into, read[:, t], np.concatenate([to_gates, to_new], axis=1))
                carried = carried * (1 - update) + through * reset + to_gates @ w[f"gate_{side}"].T
            out |= {f"in_{side}": into, f"gate_{side}": gate, f"new_{side}": fresh}
        return out


def train_network(words: list[tuple[bytes, int]], classes: int, setting: Training) -> ByteNetwork:
    """Adam over batches of words of one length, lengths drawn by their share."""
    network = ByteNetwork.fresh(setting.hidden, classes, setting.seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, label in words:
        by_length.setdefault(len(word), []).append((word, label))
    packed = [
        (np.frombuffer(b"".join(w for w, _ in group), np.uint8).reshape(len(group), -1), np.array([c for _, c in group]))
        for _, group in sorted(by_length.items())
    ]
    shares = np.array([len(labels) for _, labels in packed], float)
    draw = np.random.default_rng(setting.seed)
    first = {name: np.zeros_like(value) for name, value in network.weights.items()}
    second = {name: np.zeros_like(value) for name, value in network.weights.items()}
    for step in range(1, setting.steps + 1):
        data, labels = packed[draw.choice(len(packed), p=shares / shares.sum())]
        rows = draw.integers(0, len(labels), min(setting.batch, len(labels)))
        rate = setting.rate * (1 - 0.9 * step / setting.steps)
        for name, slope in network.gradients(data[rows], labels[rows]).items():
            slope = np.clip(slope, -1, 1)
            first[name] += 0.1 * (slope - first[name])
            second[name] += 0.01 * (slope * slope - second[name])
            size = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
            network.weights[name] -= (rate * size).astype(np.float32)
    return network


def parts_of(raw: bytes) -> list[bytes]:
    return [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]


_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, learn, setting: Training = Training()) -> tuple[list[str], ByteNetwork | None]:
    """Languages and network from the rows where ``learn`` holds, text and lang are not null."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row for each language.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return [], None
    share = F.create_map(
        *[F.lit(x) for lang in languages for x in (lang, min(1.0, setting.docs_per_language / counts[lang]))]
    )[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit(setting.seed), "doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    blank = r"[\x20\x09-\x0D]+"
    words = (
        rows.where(drawn < share)
        .select("doc_id", "lang", F.posexplode(F.split("text", blank)).alias("at", "word"))
        .where(F.col("word").rlike(r"\p{L}"))
        .orderBy(F.xxhash64(F.lit(setting.seed), "doc_id", "at", "word"))
        .limit(setting.train_words)
        .select("word", "lang")
        .collect()
    )
    number = {lang: n for n, lang in enumerate(languages)}
    samples = sorted((part, number[r["lang"]]) for r in words for part in parts_of(r["word"].encode()))
    if not samples:
        return languages, None
    return languages, train_network(samples, len(languages), setting)


class _WordTable:
    """Sums of position distributions and position counts, by word."""

    def __init__(self, network: ByteNetwork, classes: int, limit: int = 400_000):
        self.network, self.classes, self.limit = network, classes, limit
        self.reset()

    def reset(self):
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((1024, self.classes + 1))

    def add(self, words: list[bytes]) -> None:
        start = len(self.row)
        self.row.update(zip(words, range(start, start + len(words))))
        while len(self.sums) < start + len(words):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for n, word in enumerate(words, start):
            for part in parts_of(word):
                by_length.setdefault(len(part), []).append((n, part))
        for length, group in by_length.items():
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                data = np.frombuffer(b"".join(p for _, p in some), np.uint8).reshape(-1, length)
                found = self.network.positions(data)[0].sum(1)
                rows = np.array([n for n, _ in some])
                np.add.at(self.sums[:, :-1], rows, found)
                np.add.at(self.sums[:, -1], rows, length)


def _labelled(model, schema: pa.Schema):
    languages, network = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordTable(network, len(languages)) if network else None
        for batch in pieces(batches):
            names, scores = [], []
            texts = texts_of(batch)
            split = [split_words(text) if network and _LETTER.search(text) else [] for text in texts]
            if table:
                held = set().union(*split)
                if len(table.row) + len(held.difference(table.row)) > table.limit:
                    table.reset()
                table.add(list(held.difference(table.row)))
            for words in split:
                if not words:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table.sums[np.fromiter(map(table.row.__getitem__, words), np.int64, len(words))].sum(0)
                pooled = total[:-1] / total[-1]
                best = int(pooled.argmax())
                names.append(languages[best])
                scores.append(min(1.0, float(pooled[best])))
            made = {"lang_pred": names, "score": scores}
            arrays = [
                pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def predict(docs: DataFrame, model) -> DataFrame:
    """Add lang_pred and score to doc_id."""
    out = StructType([docs.schema["doc_id"]]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.select("doc_id", "text").mapInArrow(_labelled(model, to_arrow_schema(out)), out)


def identify_languages(docs: DataFrame, setting: Training = Training()) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of fold 2 of 4 are held out from training."""
    held_out = fold("doc_id", 4) == 2
    model = fit(docs, ~held_out, replace(setting))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
