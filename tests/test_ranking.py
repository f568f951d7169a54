import random

from tidewatch.operators.ranking import with_position


def test_positions_match_a_sort(spark):
    random.seed(7)
    values = [(random.randrange(50), i) for i in range(2000)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = {(r["a"], r["b"]): r["position"] for r in with_position(rows, ["a", "b"]).collect()}
    assert got == {value: i for i, value in enumerate(sorted(values), 1)}


def test_many_partitions_and_no_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(100).repartition(3)
        ranked = with_position(rows, ["id"])
        assert all(r["position"] == r["id"] + 1 for r in ranked.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_position(spark.range(0), ["id"]).collect() == []
