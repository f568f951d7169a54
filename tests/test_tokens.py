import pytest
from pyspark.sql import functions as F

from tests.helpers import names_of, plan_text, token_map
from tidewatch.operators import tokens

TWELVE = [f"Firma {letter}" for letter in "ABCDEFGHIJKL"]


@pytest.fixture(scope="module")
def twelve(spark):
    return tokens.build_dictionary(names_of(spark, *TWELVE))


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "key int, text string")


def restored(spark, dictionary, *values):
    out = tokens.unmask_text(texts(spark, *values), dictionary, ["key"], ["text"])
    return [row["text"] for row in out.orderBy("key").collect()]


def test_first_name_gets_number_one(spark):
    assert token_map(tokens.build_dictionary(names_of(spark, "Ada"))) == {"Ada": "CUSTOMER_1"}


def test_repeated_name_keeps_its_token(spark):
    dictionary = tokens.build_dictionary(names_of(spark, "Ada", "Ada"))
    assert token_map(dictionary) == {"Ada": "CUSTOMER_1"}


def test_numbers_follow_first_appearance(spark):
    dictionary = tokens.build_dictionary(names_of(spark, "C", "A", "C", "B"))
    assert token_map(dictionary) == {"C": "CUSTOMER_1", "A": "CUSTOMER_2", "B": "CUSTOMER_3"}


def test_names_differ_by_case_and_spaces(spark):
    dictionary = tokens.build_dictionary(names_of(spark, "Ada", "ada", " Ada"))
    assert len(token_map(dictionary)) == 3


@pytest.mark.parametrize("name", ["", "   ", "\t\n", "  ", "\x1c\x1d", None])
def test_blank_names_are_rejected(spark, name):
    rows = names_of(spark, name, "Ada")
    good, bad = tokens.split_by_name(rows)
    assert [r["customer_name"] for r in good.collect()] == ["Ada"]
    assert [(r["id"], r["reason"]) for r in bad.collect()] == [(1, tokens.EMPTY_NAME)]
    assert token_map(tokens.build_dictionary(rows)) == {"Ada": "CUSTOMER_1"}


@pytest.mark.parametrize("name", ["Çam", "ı", "日本", " x", " z", "-"])
def test_unusual_names_are_kept(spark, name):
    assert token_map(tokens.build_dictionary(names_of(spark, name))) == {name: "CUSTOMER_1"}


def test_identifier_must_be_text(spark):
    numbers = spark.createDataFrame([(1, 123)], "id bigint, customer_name int")
    with pytest.raises(TypeError):
        tokens.build_dictionary(numbers)


def test_mask_and_unmask_are_inverse(spark, twelve):
    rows = names_of(spark, *TWELVE, *TWELVE[:3])
    masked = tokens.mask(rows, twelve)
    assert masked.count() == 15 and "customer_name" not in masked.columns
    back = tokens.unmask(masked, twelve).select("id", "customer_name")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_unknown_token_fails_or_goes_to_quarantine(spark, twelve):
    rows = spark.createDataFrame([("CUSTOMER_99",), ("CUSTOMER_2",)], "customer_id string")
    with pytest.raises(Exception, match="unknown token CUSTOMER_99"):
        tokens.unmask(rows, twelve).collect()
    lenient = tokens.unmask(rows, twelve, strict=False)
    assert {tuple(r) for r in lenient.collect()} == {("CUSTOMER_99", None), ("CUSTOMER_2", "Firma B")}
    strangers = tokens.unknown_tokens(rows, twelve).collect()
    assert [(r["customer_id"], r["reason"]) for r in strangers] == [("CUSTOMER_99", "UNKNOWN_TOKEN")]


def test_text_gets_its_name(spark, twelve):
    assert restored(spark, twelve, "CUSTOMER_1 has the highest revenue.") == [
        "Firma A has the highest revenue."
    ]


def test_tokens_match_as_a_whole(spark, twelve):
    values = [
        "CUSTOMER_1, CUSTOMER_10 and CUSTOMER_12CUSTOMER_2",
        "CUSTOMER_100 CUSTOMER_01 CUSTOMER_ C CUSTOMER",
        "line\nCUSTOMER_3\n\nXCUSTOMER_3X\n",
        "",
        "no token $1 \\ here",
        None,
    ]
    assert restored(spark, twelve, *values) == [
        "Firma A, Firma J and Firma LFirma B",
        "CUSTOMER_100 CUSTOMER_01 CUSTOMER_ C CUSTOMER",
        "line\nFirma C\n\nXFirma CX\n",
        "",
        "no token $1 \\ here",
        None,
    ]


def test_replaced_text_is_not_searched_again(spark):
    dictionary = tokens.build_dictionary(names_of(spark, "CUSTOMER_2 Ltd", "Beta"))
    assert restored(spark, dictionary, "CUSTOMER_1/CUSTOMER_2") == ["CUSTOMER_2 Ltd/Beta"]


def test_arrays_and_several_columns(spark, twelve):
    rows = spark.createDataFrame(
        [(1, "CUSTOMER_1", None, ["a CUSTOMER_2", None, "b"]), (2, "x", "CUSTOMER_3", None)],
        "key int, one string, two string, many array<string>",
    )
    out = tokens.unmask_text(rows, twelve, ["key"], ["one", "two"], ["many"])
    assert {tuple(map(str, r)) for r in out.collect()} == {
        ("1", "Firma A", "None", "['a Firma B', None, 'b']"),
        ("2", "x", "Firma C", "None"),
    }


def test_prefix(spark):
    dictionary = tokens.build_dictionary(names_of(spark, "Ada"), prefix="VENDOR")
    assert token_map(dictionary) == {"Ada": "VENDOR_1"}
    out = tokens.unmask_text(
        texts(spark, "VENDOR_1 CUSTOMER_1"), dictionary, ["key"], ["text"], prefix="VENDOR"
    )
    assert out.first()["text"] == "Ada CUSTOMER_1"
    with pytest.raises(ValueError):
        tokens.build_dictionary(names_of(spark, "Ada"), prefix="A.*")


def test_extension_keeps_tokens_and_continues(spark):
    first = tokens.build_dictionary(names_of(spark, "B", "A"))
    more = tokens.build_dictionary(names_of(spark, "Z", "A", "Y"), previous=first)
    assert token_map(more) == {
        "B": "CUSTOMER_1",
        "A": "CUSTOMER_2",
        "Z": "CUSTOMER_3",
        "Y": "CUSTOMER_4",
    }
    same = tokens.build_dictionary(names_of(spark, "A"), previous=first)
    assert token_map(same) == token_map(first)


def test_without_previous_numbers_restart(spark):
    tokens.build_dictionary(names_of(spark, "A", "B"))
    assert token_map(tokens.build_dictionary(names_of(spark, "Yeni"))) == {"Yeni": "CUSTOMER_1"}


def test_export_is_name_and_token(spark, twelve):
    assert tokens.export_map(twelve).columns == ["name", "token"]
    assert tokens.build_dictionary(names_of(spark)).count() == 0


def test_masked_projection_has_no_name_and_no_id(spark, sample):
    dictionary = tokens.build_dictionary(sample)
    masked = tokens.masked_sales(sample, dictionary)
    assert masked.columns == [
        "customer_id",
        "transaction_date",
        "category",
        "quantity",
        "unit_sales_price",
        "unit_cost",
        "payment_term",
    ]
    assert masked.count() == sample.count()


def test_numbering_never_uses_one_partition(spark):
    names = tokens.first_seen(names_of(spark, *TWELVE))
    ordered = names.repartitionByRange("first_key").sortWithinPartitions("first_key")
    assert "SinglePartition" not in plan_text(ordered)
    dictionary = tokens.build_dictionary(names_of(spark, *TWELVE))
    assert "SinglePartition" not in plan_text(dictionary)


def test_hot_customer_in_a_shuffled_mask_join(spark):
    """A third of all rows belongs to one name, and the dictionary is not broadcast."""
    rows = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("customer_name"),
    )
    dictionary = tokens.build_dictionary(rows)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        masked = tokens.mask(rows, dictionary)
        assert "BroadcastHashJoin" not in plan_text(masked)
        counts = {r["customer_id"]: r["count"] for r in masked.groupBy("customer_id").count().collect()}
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert counts["CUSTOMER_1"] == 2000 and sum(counts.values()) == 6000
