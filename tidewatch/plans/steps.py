"""A run whose steps stand on their own, so that one may fail and be taken up again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.operators import inbox, playbook, quality, risk
from tidewatch.plans.risk_run import masked_metrics
from tidewatch.schemas import ERROR

_DONE = "step string"


class Steps:
    """Steps that write their output each, with a marker when it is whole.

    A step that fails leaves an empty output and a row in ``errors``; steps after
    it work on what there is. A rerun in the same folder reads the output of steps
    with a marker and runs the others, so it goes on where the first run broke.
    """

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory.rstrip("/")
        self._failed: list[tuple[str, str, str]] = []
        self._again: set[str] = set()

    def _done(self) -> set[str]:
        try:
            rows = self.spark.read.schema(_DONE).parquet(f"{self.directory}/done")
            return {row["step"] for row in rows.collect()}
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return set()
            raise

    def run(self, name: str, build: Callable[..., DataFrame], schema: str, *after: str) -> DataFrame:
        """The stored output of a step; ``build`` gets the outputs of the steps ``after`` which it comes.

        A step whose input changed in this run is run again.
        """
        path = f"{self.directory}/{name}"
        if name not in self._done() or self._again & set(after):
            self._again.add(name)
            try:
                build(*[self.output(step) for step in after]).write.mode("overwrite").parquet(path)
                self.spark.createDataFrame([(name,)], _DONE).coalesce(1).write.mode("append").parquet(f"{self.directory}/done")
            except Exception as problem:
                self._failed.append((name, type(problem).__name__, f"STEP_FAILED {str(problem)[:500]}"))
                self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return self.output(name)

    def output(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}")

    def errors(self) -> DataFrame:
        """A row for each step that failed in this run."""
        return self.spark.createDataFrame(self._failed, ERROR)


_METRICS = (
    "customer_id string, periods bigint, current_period date, current_quantity bigint, max_single_drop double, "
    "last_drop double, two_period_drop double, first_price double, last_price double, first_cost double, "
    "last_cost double, first_margin double, current_margin double, cost_growth_pct double, price_growth_pct double, "
    "growth_gap double"
)
_FINDINGS = "customer_id string, risk_type string, severity string, evidence string, metric_value double, pos bigint"
_STRATEGIES = (
    "customer_id string, risk_type string, strategy_title string, rationale string, action_steps array<string>, "
    "priority string, pos bigint"
)
_MESSAGES = (
    "customer_id string, risk_type string, channel string, subject string, body string, tone string, pos bigint, "
    "words int, length_ok boolean"
)


def run_in_steps(
    sales: DataFrame,
    directory: str,
    config: RiskConfig = RiskConfig(),
    order_key: str = "id",
    changed: dict[str, Callable[..., DataFrame]] | None = None,
) -> dict[str, DataFrame]:
    """A run at customer grain as steps under ``directory``; ``changed`` puts own functions in place of steps.

    Rows the contract rejects, gaps between findings, strategies and drafts, and
    failed steps are in ``errors``.
    """
    if config.grain:
        raise ValueError("steps work at customer grain")
    steps = Steps(sales.sparkSession, directory)
    valid, rejected = quality.enforce_contract(sales)
    build = {
        "dictionary_and_metrics": lambda: _both(valid, config, order_key),
        "findings": lambda both: risk.findings(both.drop("name", "token_no"), config),
        "strategies": lambda findings: playbook.strategies(findings),
        "messages": lambda strategies: playbook.length_check(playbook.messages(strategies)),
        "inbox": lambda findings, strategies, messages, both: inbox.named_cards(
            inbox.cards(findings, strategies, messages),
            both.select("name", F.col("customer_id").alias("token"), "token_no"),
            config.prefix,
        ),
    } | (changed or {})
    both = "dictionary_and_metrics"
    order = {
        both: (f"{_METRICS}, name string, token_no bigint",),
        "findings": (_FINDINGS, both),
        "strategies": (_STRATEGIES, "findings"),
        "messages": (_MESSAGES, "strategies"),
        "inbox": ("customer_id string, customer_name string", "findings", "strategies", "messages", both),
    }
    outputs = {name: steps.run(name, build[name], schema, *after) for name, (schema, *after) in order.items()}
    gaps = inbox.coverage_gaps(outputs["findings"], outputs["strategies"], outputs["messages"])
    found = [
        quality.as_errors(rejected, "load", F.col(order_key)),
        quality.as_errors(gaps.withColumnRenamed("problems", "reasons"), "coverage", F.col("customer_id")),
        steps.errors(),
    ]
    return outputs | {"errors": reduce(DataFrame.unionByName, found)}


def _both(valid: DataFrame, config: RiskConfig, order_key: str) -> DataFrame:
    """Metrics by token next to the names, as one step."""
    metrics, dictionary = masked_metrics(valid, config, order_key)
    names = dictionary.select(F.col("token").alias("customer_id"), "name", "token_no")
    return metrics.join(names, "customer_id")
