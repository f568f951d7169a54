"""Sales per customer and period, and how they move over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expressions import margin_ratio, rounded

PERIOD_MONTHS = {"month": 1, "quarter": 3}


def period_start(date: Column, period: str) -> Column:
    return F.trunc(date, period)


def period_totals(
    sales: DataFrame,
    keys: Sequence[str] = ("customer_id",),
    period: str = "quarter",
    first_key: str | None = None,
) -> DataFrame:
    """A4 as sums that can be merged: ``quantity, revenue, cost_total``.

    Sums are built before the shuffle, so only one row per task, key and period
    moves, also for a customer with a third of all rows. ``first_key`` carries
    the smallest order key along, from which tokens are numbered later.
    """
    amount = F.col("quantity")
    sums = [
        F.sum(amount.cast("bigint")).alias("quantity"),
        F.sum(amount * F.col("unit_sales_price")).alias("revenue"),
        F.sum(amount * F.col("unit_cost")).alias("cost_total"),
    ]
    if first_key:
        sums.append(F.min(first_key).alias("first_key"))
    return sales.groupBy(
        *keys, period_start(F.col("transaction_date"), period).alias("period")
    ).agg(*sums)


def merge_totals(totals: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Add up partial ``period_totals`` of several inputs."""
    sums = [F.sum(c).alias(c) for c in ("quantity", "revenue", "cost_total")]
    if "first_key" in totals.columns:
        sums.append(F.min("first_key").alias("first_key"))
    return totals.groupBy(*keys, "period").agg(*sums)


def unit_values(totals: DataFrame) -> DataFrame:
    """A4: quantity-weighted unit price and unit cost per period."""
    return totals.withColumns(
        {
            "unit_price": F.try_divide("revenue", "quantity"),
            "unit_cost": F.try_divide("cost_total", "quantity"),
        }
    )


def fill_periods(
    totals: DataFrame,
    keys: Sequence[str] = ("customer_id",),
    period: str = "quarter",
    last_period: Column | None = None,
) -> DataFrame:
    """A5: add periods without orders, with quantity 0, up to ``last_period``.

    Each row fills the gap up to the next order of its customer, so one window
    over period rows does it and no calendar is joined. ``last_period``
    defaults to the newest period of the input.
    """
    if last_period is None:
        last_period = totals.select(F.max("period")).scalar()
    step = F.make_interval(months=F.lit(PERIOD_MONTHS[period]))
    following = F.lead("period").over(Window.partitionBy(*keys).orderBy("period"))
    until = F.coalesce((following - step).cast("date"), last_period)
    filled = totals.withColumn("_until", until).withColumn(
        "_period", F.explode(F.sequence("period", F.greatest("_until", "period"), step))
    )
    observed = F.col("_period") == F.col("period")
    sums = {c: F.when(observed, F.col(c)).otherwise(F.lit(0)) for c in ("quantity", "revenue", "cost_total")}
    return filled.withColumns(sums).withColumn("period", F.col("_period")).drop("_until", "_period")


def drop_pct(before: Column, now: Column) -> Column:
    """Decline in percent, rounded; NULL without a base."""
    return rounded(F.try_divide(before - now, before) * 100)


def period_trends(totals: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Each period next to the one and the two before it.

    One window specification, hence one sort. ``single_drop`` and ``two_drop``
    are in percent, positive for a decline, NULL without a positive base.
    """
    by_time = Window.partitionBy(*keys).orderBy("period")
    now = F.col("quantity")
    before, earlier = F.lag("quantity", 1).over(by_time), F.lag("quantity", 2).over(by_time)
    return unit_values(totals).withColumns(
        {
            "previous_quantity": before,
            "earlier_quantity": earlier,
            "single_drop": drop_pct(before, now),
            "two_drop": drop_pct(earlier, now),
        }
    )


def growth_trends(trends: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Cost growth minus price growth since the first period, in points."""
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("period")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first_price = F.first_value("unit_price", True).over(so_far)
    first_cost = F.first_value("unit_cost", True).over(so_far)
    cost_growth = F.try_divide("unit_cost", first_cost)
    price_growth = F.try_divide("unit_price", first_price)
    return trends.withColumns(
        {
            "cost_growth_pct": rounded((cost_growth - 1) * 100),
            "price_growth_pct": rounded((price_growth - 1) * 100),
            "growth_gap": rounded((cost_growth - price_growth) * 100),
        }
    )


def customer_metrics(trends: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """One row per customer from its period rows.

    The windows already placed each customer in one partition, so this
    aggregation adds no shuffle. First and last prices skip empty periods.
    """
    seen = F.when(F.col("unit_price").isNotNull(), F.col("period"))
    picks = [
        F.count("*").alias("periods"),
        F.max("period").alias("current_period"),
        F.max_by("quantity", "period").alias("current_quantity"),
        F.max("single_drop").alias("max_single_drop"),
        F.max_by("single_drop", "period").alias("last_drop"),
        F.max_by("two_drop", "period").alias("two_period_drop"),
        F.min_by("unit_price", seen).alias("first_price"),
        F.max_by("unit_price", seen).alias("last_price"),
        F.min_by("unit_cost", seen).alias("first_cost"),
        F.max_by("unit_cost", seen).alias("last_cost"),
    ]
    if "first_key" in trends.columns:
        picks.append(F.min("first_key").alias("first_key"))
    return trends.groupBy(*keys).agg(*picks).withColumns(first_to_last())


def first_to_last() -> dict[str, Column]:
    """Margins and growth from the first and last unit values of a customer."""
    cost_growth = F.try_divide("last_cost", "first_cost")
    price_growth = F.try_divide("last_price", "first_price")
    return {
        "first_margin": rounded(margin_ratio(F.col("first_price"), F.col("first_cost"))),
        "current_margin": rounded(margin_ratio(F.col("last_price"), F.col("last_cost"))),
        "cost_growth_pct": rounded((cost_growth - 1) * 100),
        "price_growth_pct": rounded((price_growth - 1) * 100),
        "growth_gap": rounded((cost_growth - price_growth) * 100),
    }


def margin_and_velocity(sales: DataFrame, period: str = "quarter", key: str = "customer_id") -> DataFrame:
    """Mean row margin and change of the newest period, per customer.

    One pass: the row margins are summed per period next to the quantities.
    """
    margin = margin_ratio(F.col("unit_sales_price"), F.col("unit_cost"))
    per_period = sales.groupBy(
        key, period_start(F.col("transaction_date"), period).alias("period")
    ).agg(
        F.sum(F.col("quantity").cast("bigint")).alias("quantity"),
        F.sum(margin).alias("margins"),
        F.count(margin).alias("rows"),
    )
    before = F.lag("quantity").over(Window.partitionBy(key).orderBy("period"))
    change = F.try_divide(F.col("quantity") - before, before) * 100
    return (
        per_period.withColumn("change", change)
        .groupBy(key)
        .agg(
            rounded(F.try_divide(F.sum("margins"), F.sum("rows"))).alias("avg_margin_ratio"),
            rounded(F.max_by("change", "period")).alias("order_velocity_change_pct"),
        )
    )
