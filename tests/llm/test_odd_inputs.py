"""Every operator and stage on odd rows, on no rows, and beside columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (
    bpe,
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


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (5, 0, 1), (9, 1, None), (7, None, 0), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away from all of it today."
    rows = [(1, item), (2, None), (3, ""), (4, item), (None, "nine words that nobody else has ever put down here")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def operators(labels, benchmark, vocabulary):
    return {
        "pii": pii.personal_data,
        "redact": pii.redact,
        "classify": lambda d: quality_classifier.classify(d, labels),
        "near": jaccard_join.near_duplicates,
        "repeats": substring_dedup.remove_repeats,
        "language": language_id.identify_languages,
        "rules": lambda d: quality_rules.apply_rules(d, labels),
        "bpe": lambda d: bpe.encode_decode(d, vocabulary),
        "leaks": lambda d: decontamination.contamination(d, benchmark),
        "shards": sharding.shard_documents,
        "files": lambda d: token_output.token_files(d, vocabulary),
    }


NAMES = "pii redact classify near repeats language rules bpe leaks shards files".split()


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_odd_row(name, operators, odd, odd_rows):
    found = operators[name](odd).select("doc_id").collect()
    order = lambda i: (i is None, i or 0)
    assert sorted((r[0] for r in found), key=order) == sorted((i for i, _ in odd_rows), key=order)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(name, operators, nothing):
    assert operators[name](nothing).count() == 0


def test_empty_tables_beside(spark, odd, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    assert quality_rules.apply_rules(odd, none).count() == len(odd_rows)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(odd, items).where("contaminated").count() == 0


def test_defined_results(operators, odd):
    rows = {r["doc_id"]: r for r in operators["rules"](odd).where("doc_id > 1").collect()}
    assert rows[2]["n_words"] == rows[3]["n_words"] == rows[4]["n_words"] == 0 and rows[2]["base_failed"]
    assert rows[9]["n_repeat_words"] == 17
    found = {r["doc_id"]: r for r in operators["language"](odd).where("doc_id > 1").collect()}
    assert [found[n]["lang_pred"] for n in (2, 3, 4)] == ["und"] * 3
    near = {(r["doc_id"], r["n_copies"]): r for r in operators["near"](odd).collect()}
    assert near[1, 2]["n_links"] == 1 and near[10, 2]["class_id"] == 9 and near[2, 1]["class_id"] == 2
    gone = {r["doc_id"]: r for r in operators["repeats"](odd).where("doc_id > 1").collect()}
    assert gone[9]["n_removed"] == 0 and gone[10]["n_removed"] == 17 and gone[10]["kept"] == ""
    leaks = operators["leaks"](odd).where("contaminated").collect()
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in leaks} == {(1, (1, 4))}
    files = {r["doc_id"]: r for r in operators["files"](odd).where("doc_id > 1").collect()}
    assert files[2]["n_tokens"] == files[3]["n_tokens"] == 1


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, odd, labels, benchmark, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    result = stage(spark, odd, str(tmp_path))
    if name != "bpe_encoding":
        assert result.columns == odd.columns and result.dtypes == odd.dtypes
        assert {r[0] for r in result.select("_raw").union(result.select("_quality_score")).collect()} == {"x"}
    assert 0 < result.count() <= odd.count()
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    if name == "ngram_jaccard_join":
        kept = result.groupBy("doc_id").count().collect()
        assert {r["doc_id"]: r["count"] for r in kept} == {
            1: 2, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1,
        }
    if name == "personal_data":
        text = result.where(F.col("doc_id").isNull() & F.col("text").isNotNull()).first()
        assert text["text"] == "A row without an id: mail me at [EMAIL] or call [PHONE]."
        assert text["n_chars"] == len(text["text"])
