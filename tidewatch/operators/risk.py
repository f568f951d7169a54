"""Who is at risk, how badly, and why."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.functions.expressions import decimal_text, rounded
from tidewatch.functions.wording import EVIDENCE, NOT_MEASURED


def scoped_drop(config: RiskConfig) -> Column:
    """The single-period drop the rules look at."""
    return F.col("max_single_drop" if config.drop_scope == "any" else "last_drop")


def holds(test: Column) -> Column:
    """A test on a missing metric does not hold."""
    return F.coalesce(test, F.lit(False))


def classify(metrics: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add ``churn, margin, risk_type``; healthy rows have no type."""
    churn = holds(F.col("two_period_drop") >= config.two_period_drop_pct) | holds(
        scoped_drop(config) >= config.single_period_drop_pct
    )
    margin = holds(F.col("current_margin") < config.min_margin) | holds(
        F.col("growth_gap") >= config.growth_gap_points
    )
    return metrics.withColumns({"churn": churn, "margin": margin}).withColumn(
        "risk_type",
        F.when(F.col("churn") & F.col("margin"), "BOTH")
        .when(F.col("churn"), "CHURN_RISK")
        .when(F.col("margin"), "MARGIN_RISK"),
    )


def grade(classified: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add ``severity`` and ``metric_value`` to classified rows.

    The metric is a percent for churn, a ratio for margin, a score for both.
    """
    drop = F.greatest("two_period_drop", scoped_drop(config))
    margin = F.col("current_margin")
    severity = (
        F.when(F.col("risk_type") == "BOTH", "CRITICAL")
        .when(holds(drop >= config.high_drop_pct) | holds(margin < config.high_margin), "HIGH")
        .when(holds(drop >= config.medium_drop_pct) | holds(margin < config.medium_margin), "MEDIUM")
        .otherwise("LOW")
    )
    shortfall = F.greatest(F.lit(0.0), (F.lit(config.min_margin) - margin) * 100)
    metric = (
        F.when(F.col("risk_type") == "CHURN_RISK", drop)
        .when(F.col("risk_type") == "MARGIN_RISK", margin)
        .otherwise(drop + shortfall)
    )
    return classified.withColumns({"severity": severity, "metric_value": rounded(metric)})


def with_evidence(graded: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add a sentence built from the token and the rounded metrics.

    The numbers are printed in a projection of their own. Each serves several
    sentences, so Catalyst keeps that projection, and the generated code of
    neither step grows past what the JVM compiles.
    """
    numbers = {
        "two": F.col("two_period_drop"),
        "single": scoped_drop(config),
        "margin": F.col("current_margin") * 100,
        "gap": F.col("growth_gap"),
    }
    texts = {
        f"_{mark}": F.coalesce(decimal_text(value, 1), F.lit(NOT_MEASURED))
        for mark, value in numbers.items()
    }
    marks = {"{customer}": F.col("customer_id")}
    marks |= {"{" + mark + "}": F.col(f"_{mark}") for mark in numbers}

    def filled(template: str) -> Column:
        parts = re.split("(" + "|".join(map(re.escape, marks)) + ")", template)
        return F.concat(*[marks[part] if part in marks else F.lit(part) for part in parts])

    kind = F.col("risk_type")
    sentence = F.when(kind == "CHURN_RISK", filled(EVIDENCE["CHURN_RISK"]))
    for other in ("MARGIN_RISK", "BOTH"):
        sentence = sentence.when(kind == other, filled(EVIDENCE[other]))
    return graded.withColumns(texts).withColumn("evidence", sentence).drop(*texts)


def at_risk(classified: DataFrame) -> DataFrame:
    """drop healthy customers."""
    return classified.where(F.col("risk_type").isNotNull())


def findings(metrics: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Rows of the findings table from metrics keyed by ``customer_id``.

    ``pos`` is the place of the finding in the output: the token number.
    """
    graded = with_evidence(grade(at_risk(classify(metrics, config)), config), config)
    return graded.select(
        "customer_id",
        *config.grain,
        "risk_type",
        "severity",
        "evidence",
        "metric_value",
        position(config.prefix).alias("pos"),
    )


def position(prefix: str) -> Column:
    return F.substring(F.col("customer_id"), len(prefix) + 2, 19).cast("bigint")
