"""The corpus pipeline: five stages, each by one of the text operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.

1. quality classifier: learned on the labelled documents of its input; what it
   predicts to be of quality 0 goes
2. n-gram Jaccard join: of each class of near duplicates one document stays
3. benchmark decontamination: documents that hold a benchmark item go, also with
   other numbers or names
4. personal data: every span in a text becomes the name of its kind
5. encoding: the token ids and decoded text of each whole document

All stages but the last return the columns of their input. Null texts count as
empty; empty tables pass through; further columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontamination, jaccard_join, pii, quality_classifier
from tidewatch.llm.queries import word_vocabulary
from tidewatch.llm.shared import free_name, table
from tidewatch.sources.storage import store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a score below the cut. Labels teach the model and decide nothing else."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = free_name("_quality_score", docs)
    scored = quality_classifier.score(docs, model, name)
    return scored.where(F.col(name) >= quality_classifier.CUT).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact texts; ``n_chars`` of a changed text is counted anew."""
    raw = free_name("_raw_text", docs)
    redacted = pii.redact(docs.withColumn(raw, F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = ~F.col("text").eqNullSafe(F.col(raw))
        counted = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind)
        redacted = redacted.withColumn("n_chars", counted)
    return redacted.select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded text."""
    coded = bpe.encode_decode(docs, word_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("bpe_encoding", encoding_stage),
]

#: A learned model and an automaton are not SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each writes Parquet into the shared folder and the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
