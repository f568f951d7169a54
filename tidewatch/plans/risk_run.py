"""One analysis run: from sales rows to the action inbox."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.operators import inbox, leak_audit, playbook, quality, risk, summaries
from tidewatch.operators.periods import (
    customer_metrics,
    fill_periods,
    period_totals,
    period_trends,
)
from tidewatch.operators.ranking import with_position
from tidewatch.operators.tokens import (
    extend_dictionary,
    mask,
    number_names,
    token_for,
    unknown_tokens,
)
from tidewatch.sources.sales_table import check_columns, check_input
from tidewatch.sources.storage import store


class RiskRun:
    """Outputs of one run over ``sales``. All but the dictionary and the inbox
    hold tokens only.

    The metrics are computed and stored when first asked for. Every other
    output is a plan over those few stored rows. The pass over the sales also
    counts the rows that the contract rejects; only if there are any does
    ``errors`` read the sales again, to name them.
    """

    def __init__(
        self,
        sales: DataFrame,
        config: RiskConfig = RiskConfig(),
        order_key: str = "id",
        previous: DataFrame | None = None,
    ) -> None:
        self.config, self.order_key, self.previous = config, order_key, previous
        self._contract = Observation("contract")
        observed = sales.observe(self._contract, F.count_if(quality.breaks_contract()).alias("rejected"))
        self.valid, _ = quality.enforce_contract(observed)
        self._sales = sales

    @cached_property
    def _numbered(self) -> tuple[DataFrame, DataFrame]:
        return masked_metrics(self.valid, self.config, self.order_key, self.previous)

    @property
    def rejected(self) -> DataFrame:
        """Rows the contract rejects, with their reasons; no second pass if the first one met none."""
        _, rejected = quality.enforce_contract(self._sales)
        # Without any metrics there may have been no pass to count in.
        sound = not self.metrics.isEmpty() and not self._contract.get["rejected"]
        return rejected.limit(0) if sound else rejected

    @property
    def metrics(self) -> DataFrame:
        return self._numbered[0]

    @property
    def dictionary(self) -> DataFrame:
        return self._numbered[1]

    @cached_property
    def findings(self) -> DataFrame:
        return risk.findings(self.metrics, self.config)

    @cached_property
    def strategies(self) -> DataFrame:
        return playbook.strategies(self.findings, grain=self.config.grain)

    @cached_property
    def messages(self) -> DataFrame:
        return playbook.length_check(playbook.messages(self.strategies, self.config.grain))

    @cached_property
    def cards(self) -> DataFrame:
        findings = self.findings
        if self.config.grain:
            findings = inbox.first_per_customer(findings)
        return inbox.drafted_cards(findings)

    @cached_property
    def inbox(self) -> DataFrame:
        return inbox.named_cards(self.cards, self.dictionary, self.config.prefix)

    @cached_property
    def errors(self) -> DataFrame:
        """What any check of a hand-off found, in one table.

        Rows the contract rejects, findings and drafts that do not match one to
        one, tokens without a name, drafts of a wrong length, and real names in
        texts that must hold tokens only.
        """
        findings, strategies, messages = self.findings, self.strategies, self.messages
        gaps = inbox.coverage_gaps(findings, strategies, messages, self.config.grain)
        gaps = gaps.withColumnRenamed("problems", "reasons")
        lengths = messages.where(~F.col("length_ok")).withColumn(
            "reason", F.concat(F.lit("LENGTH_"), "channel")
        )
        texts = quality.hand_on_texts(findings, strategies, messages)
        leaked = leak_audit.leaks(texts, self.dictionary, ["key"]).select("key").distinct()
        own = F.col("customer_id")
        return reduce(
            DataFrame.unionByName,
            [
                quality.as_errors(self.rejected, "load", F.col(self.order_key)),
                quality.as_errors(gaps, "coverage", F.concat_ws("/", "customer_id", *self.config.grain)),
                quality.as_errors(unknown_tokens(findings, self.dictionary), "tokens", own),
                quality.as_errors(lengths, "length", own),
                quality.as_errors(leaked.withColumn("reason", F.lit("LEAKED_NAME")), "leaks", F.col("key")),
            ],
        )

    @cached_property
    def analysis_summary(self) -> DataFrame:
        return summaries.analysis_summary(self.findings)

    @cached_property
    def strategy_summary(self) -> DataFrame:
        return summaries.strategy_summary(self.strategies)

    @cached_property
    def run_counts(self) -> DataFrame:
        return summaries.run_counts(
            findings=self.findings,
            strategies=self.strategies,
            messages=self.messages,
            errors=self.errors,
        )

    def outputs(self) -> dict[str, DataFrame]:
        """What a run hands on, by name."""
        names = (
            "findings",
            "strategies",
            "messages",
            "inbox",
            "errors",
            "analysis_summary",
            "strategy_summary",
            "run_counts",
        )
        return {name: getattr(self, name) for name in names}


def named_metrics(sales: DataFrame, config: RiskConfig, order_key: str) -> DataFrame:
    """Metrics per customer name, with the smallest order key of the name.

    The only scan of the sales, and two shuffles: sums per customer and period,
    then period rows per customer. Names serve as grouping keys here and are
    replaced before anything is handed on; masking customer rows in place of
    sales rows keeps the dictionary join away from the large table.
    """
    keys = ["customer_name", *config.grain]
    totals = period_totals(sales, keys, config.period, order_key)
    if config.fill_empty_periods:
        # Stored, because the newest period is asked of the same rows.
        totals = fill_periods(store(totals, "totals"), keys, config.period)
    return customer_metrics(period_trends(totals, keys), keys)


def masked_metrics(
    sales: DataFrame,
    config: RiskConfig,
    order_key: str = "id",
    previous: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored metrics keyed by token, and the token dictionary.

    Without a previous dictionary and at customer grain, numbering the metric
    rows numbers the customers, and no join is left at all.
    """
    named = named_metrics(sales, config, order_key)
    if previous is None and not config.grain:
        ranked = with_position(store(named, "metrics"), ["first_key", "customer_name"], "token_no").withColumn(
            "token", token_for(F.col("token_no"), config.prefix)
        )
        dictionary = ranked.select(F.col("customer_name").alias("name"), "token", "token_no")
        metrics = ranked.withColumnRenamed("token", "customer_id")
        return metrics.drop("customer_name", "token_no", "first_key"), dictionary

    stored = store(named, "metrics")
    names = stored.groupBy(F.col("customer_name").alias("name")).agg(
        F.min("first_key").alias("first_key")
    )
    dictionary = (
        number_names(names, config.prefix)
        if previous is None
        else extend_dictionary(previous, names, config.prefix)
    )
    return mask(stored, dictionary).drop("first_key"), dictionary


def run_risk_analysis(
    sales: DataFrame,
    config: RiskConfig = RiskConfig(),
    order_key: str = "id",
    previous: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Check the input and return all outputs of a run by name.

    ``order_key`` orders names by first appearance; ``previous`` is the token
    dictionary to go on with, if tokens must stay the same across runs. Whether
    there are rows is asked of the stored metrics: on sales that are a join, even
    the first row may cost the whole join.
    """
    run = RiskRun(check_columns(sales), config, order_key, previous)
    if run.metrics.isEmpty():
        check_input(sales)
    return run.outputs()
