"""A1 to A3, A9, A10 and the text outputs: counts, summaries, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fixed
from tidewatch.functions import wording
from tidewatch.functions.expressions import finding_line, rounded, sale_line, strategy_block
from tidewatch.operators.ranking import with_position

# Rows of one customer that a join may gather in one task.
_PART_ROWS = 100_000


def row_count(sales: DataFrame) -> DataFrame:
    """A1: rows loaded."""
    return sales.agg(F.count("*").alias("records"))


def load_counts(sales: DataFrame, key: str = "customer_id") -> DataFrame:
    """A1, A2: rows loaded and exact number of distinct customers, by name or token.

    Rows are first counted per customer, with partial sums before the shuffle,
    so the distinct count needs no expansion of the input.
    """
    return (
        sales.groupBy(key)
        .agg(F.count("*").alias("rows"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("records"),
            F.count(key).alias("customers"),
        )
    )


def context_blocks(
    masked: DataFrame, block_lines: int = 200, part_rows: int = _PART_ROWS
) -> DataFrame:
    """A3: the sales of each customer as text, by date, in numbered blocks.

    Joining the ``text`` of a customer's blocks with line feeds, in ``block``
    order, gives the whole text; sales of one day are in the order of the
    printed columns. A customer with very many rows gets many blocks, never one
    huge group. Equal rows are counted before the shuffle and leave as pieces
    of at most ``block_lines`` copies, so that copies cannot pile up in one
    range either; a block holds ``block_lines`` pieces. The join that tells
    where a customer starts goes by customer and range of positions: by customer
    alone, one task would get all blocks of a customer. A customer's start row is
    repeated once for each range it reaches into, so small customers have one or
    two. Only columns move until the last step; the text is printed there.
    """
    printed = ["transaction_date", "category", "quantity", "unit_sales_price", "unit_cost"]
    pieces = (
        masked.groupBy("customer_id", *printed)
        .agg(F.count("*").alias("copies"))
        .withColumn("done", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(block_lines))))
        .withColumn("copies", F.least(F.col("copies") - F.col("done"), F.lit(block_lines)).cast("int"))
    )
    ranked = with_position(pieces, ["customer_id", *printed, "done"])
    starts = (
        ranked.groupBy("customer_id")
        .agg(F.min("position").alias("start"), F.max("position").alias("end"))
        .select(
            "customer_id",
            "start",
            F.explode(
                F.sequence(F.floor(F.col("start") / part_rows), F.floor(F.col("end") / part_rows))
            ).alias("part"),
        )
    )
    block = F.floor((F.col("position") - F.col("start")) / block_lines).cast("int")
    text = F.array_join(F.array_repeat(sale_line(), F.col("copies")), "\n")
    blocks = (
        ranked.withColumn("part", F.floor(F.col("position") / part_rows))
        .join(starts, ["customer_id", "part"])
        .groupBy("customer_id", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("position", text.alias("text")))).alias("parts"))
    )
    header = F.when(F.col("block") == 0, F.concat(F.lit("\n=== "), "customer_id", F.lit(" ===\n")))
    body = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    return blocks.select(
        "customer_id",
        "block",
        F.size("parts").alias("pieces"),
        F.concat(F.coalesce(header, F.lit("")), body).alias("text"),
    )


def _lines_or(rows: DataFrame, line: Column, empty_text: str) -> DataFrame:
    """``customer_id, line`` per row, or one fixed line when there is no row."""
    nothing = (
        rows.agg(F.count("*").alias("rows"))
        .where(F.col("rows") == 0)
        .select(F.lit(None).cast("string").alias("customer_id"), F.lit(empty_text).alias("line"))
    )
    return rows.select("customer_id", line.alias("line")).unionByName(nothing)


def finding_lines(findings: DataFrame) -> DataFrame:
    """Findings as lines, in rows so that no task holds all of them."""
    return _lines_or(findings, finding_line(), fixed.NO_FINDINGS_LINE)


def strategy_blocks(strategies: DataFrame) -> DataFrame:
    """Strategies as blocks of text."""
    return _lines_or(strategies, strategy_block(), fixed.NO_STRATEGIES_LINE)


def run_counts(**outputs: DataFrame) -> DataFrame:
    """``metric, value`` with the number of rows of each output."""
    counts = [
        df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        for name, df in outputs.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def risk_rollup(findings: DataFrame) -> DataFrame:
    """A10: findings and mean metric per risk type and severity, with totals."""

    def label(column: str) -> Column:
        return F.when(F.grouping(column) == 1, "ALL").otherwise(F.col(column)).alias(column)

    return findings.rollup("risk_type", "severity").agg(
        label("risk_type").alias("risk"),
        label("severity").alias("level"),
        F.count("*").alias("findings"),
        rounded(F.avg("metric_value")).alias("mean_metric"),
    ).select(
        F.col("risk").alias("risk_type"), F.col("level").alias("severity"), "findings", "mean_metric"
    )


def _sentence(template: str, **values: Column) -> Column:
    text = F.lit(template)
    for mark, value in values.items():
        text = F.replace(text, F.lit("{" + mark + "}"), value.cast("string"))
    return text


def analysis_summary(findings: DataFrame) -> DataFrame:
    """One row with the summary of the findings."""
    kind, total = F.col("risk_type"), F.col("total")
    counts = findings.agg(
        F.count("*").alias("total"),
        F.count_if(kind == "CHURN_RISK").alias("churn"),
        F.count_if(kind == "MARGIN_RISK").alias("margin"),
        F.count_if(kind == "BOTH").alias("both"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )
    sentence = _sentence(
        wording.ANALYSIS_SUMMARY,
        **{mark: F.col(mark) for mark in ("total", "churn", "margin", "both", "critical")},
    )
    return counts.select(
        F.when(total == 0, wording.NO_ANALYSIS_SUMMARY).otherwise(sentence).alias("analysis_summary")
    )


def strategy_summary(strategies: DataFrame) -> DataFrame:
    """One row with the summary of the recommendations."""
    counts = strategies.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("priority") == "URGENT").alias("urgent"),
    )
    sentence = _sentence(wording.STRATEGY_SUMMARY, total=F.col("total"), urgent=F.col("urgent"))
    return counts.select(
        F.when(F.col("total") == 0, fixed.NO_RISK_SUMMARY).otherwise(sentence).alias("strategy_summary")
    )
