"""The plans are the ones we want."""

import re

from pyspark.sql import functions as F

from tests.helpers import plan_text, sales_of
from tidewatch.config import RiskConfig
from tidewatch.operators import quality, summaries
from tidewatch.plans.catalog import QUERIES, Desk
from tidewatch.plans.risk_run import RiskRun, named_metrics
from tidewatch.sources import sales_table
from tidewatch.sources.warehouse import warehouse_sales

DIRECTORY = "/root/testdata/sf0.001"


def stored(spark, sample, tmp_path):
    path = str(tmp_path / "sales")
    sample.write.parquet(path)
    return sales_table.read_sales(spark, path)


def test_metrics_take_two_shuffles_and_one_sort(spark, sample, tmp_path):
    valid, _ = quality.enforce_contract(stored(spark, sample, tmp_path))
    plan = plan_text(named_metrics(valid, RiskConfig(), "id"))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Exchange") == 2
    assert plan.count("Sort [") == 1
    assert plan.count("Window [") == 1
    assert "partial_sum" in plan


def test_scan_reads_only_what_it_needs(spark, sample, tmp_path):
    sales = stored(spark, sample, tmp_path)
    plan = plan_text(named_metrics(sales, RiskConfig(), "id"))
    assert "payment_term" not in plan and "category" not in plan
    valid, _ = quality.enforce_contract(sales)
    assert "PushedFilters: [IsNotNull(transaction_date)" in plan_text(valid)


def test_outputs_come_from_stored_metrics(spark, sample, tmp_path):
    run = RiskRun(stored(spark, sample, tmp_path))
    for df in (run.findings, run.strategies, run.messages, run.cards):
        plan = plan_text(df)
        assert "Exchange" not in plan and "Python" not in plan
        assert "ranked-" in plan
    text = plan_text(run.inbox)
    assert "Python" not in text and "NestedLoop" not in text and "SinglePartition" not in text


def test_distinct_count_aggregates_before_the_shuffle(spark, sample, tmp_path):
    masked = stored(spark, sample, tmp_path).withColumnRenamed("customer_name", "customer_id")
    plan = plan_text(summaries.load_counts(masked))
    assert "Expand" not in plan and "partial_count" in plan
    assert "ReadSchema: struct<customer_name:string>" in plan_text(
        summaries.load_counts(
            stored(spark, sample, tmp_path / "again").select(F.col("customer_name").alias("customer_id"))
        )
    )


def test_view_shuffles_lines_by_order_and_part_only(spark):
    """Without broadcasts: no line-sized shuffle by customer, and A1 needs no dictionary."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = plan_text(warehouse_sales(spark, DIRECTORY))
        totals = plan_text(Desk(spark, DIRECTORY).named_totals)
        counted = plan_text(QUERIES["A1_row_count"](spark, DIRECTORY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [part.split("#")[0] for part in view.split("Exchange hashpartitioning(")[1:]]
    assert sorted(keys) == ["c_custkey", "l_orderkey", "l_partkey", "o_custkey", "o_orderkey", "p_partkey"]
    by_name = [part.split(")")[0] for part in totals.split("Exchange hashpartitioning(customer_name")[1:]]
    assert len(by_name) == 1 and by_name[0].count("#") == 2
    assert "token" not in counted and "customer_name" not in counted.split("Exchange")[0]


def test_context_parts_grow_with_a_customer(spark):
    rows = [(1, "a")] * 3 + [(2, "b")] * 40
    sales = sales_of(spark, [(name, 1 + n % 12, 1 + n, 10, 5) for n, (_, name) in enumerate(rows)])
    masked = sales.withColumnRenamed("customer_name", "customer_id")
    blocks = summaries.context_blocks(masked, 5, part_rows=4).groupBy("customer_id").count()
    assert {r["customer_id"]: r["count"] for r in blocks.collect()} == {"a": 1, "b": 8}


def test_blocks_of_one_customer_are_spread(spark, sample, tmp_path):
    """Neither the join nor the grouping hashes by customer alone."""
    masked = stored(spark, sample, tmp_path).withColumnRenamed("customer_name", "customer_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(summaries.context_blocks(masked, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [customer_id" in plan and "part" in plan
    hashed = [part.split(")")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]
    by_customer = [part for part in hashed if part.count("#") == 1]
    assert len(hashed) == 4 and len(by_customer) == 1, hashed


def test_generated_code_stays_compilable(spark, sample, capsys):
    """The JVM interprets methods above 8000 bytes of code."""
    run = RiskRun(sample)
    frames = (run.findings, run.strategies, run.messages, run.cards, run.inbox)
    run.metrics.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in frames:
            df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
