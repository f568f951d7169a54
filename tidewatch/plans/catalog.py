"""Named queries over the star-schema tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.config import RiskConfig
from tidewatch.functions import expressions as X
from tidewatch.operators import inbox, leak_audit, periods, playbook, quality, risk, summaries, tokens
from tidewatch.operators.ranking import with_position
from tidewatch.plans.risk_run import RiskRun, named_metrics
from tidewatch.plans.steps import run_in_steps
from tidewatch.sources import raw_files, sales_table
from tidewatch.sources.storage import fresh_path, store
from tidewatch.sources.warehouse import warehouse_sales, warehouse_table
from tidewatch.streaming.ids import count_once
from tidewatch.streaming.monitor import RiskMonitor, latest, sales_stream, use_disk_state

# Names first seen before this day form the known dictionary of some queries.
EARLY = "1996-01-01"


class Desk:
    """Frames that several queries of one directory start from.

    The dictionary and the stored metrics are made once per session, as one
    analysis session uses one set of tokens.
    """

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    @cached_property
    def sales(self) -> DataFrame:
        return warehouse_sales(self.spark, self.directory)

    @cached_property
    def dictionary(self) -> DataFrame:
        return tokens.build_dictionary(self.sales, order_key="customer_key")

    @cached_property
    def masked(self) -> DataFrame:
        return tokens.masked_sales(self.sales, self.dictionary)

    @cached_property
    def early_sales(self) -> DataFrame:
        return self.sales.where(F.col("transaction_date") < F.lit(EARLY).cast("date"))

    @cached_property
    def early_dictionary(self) -> DataFrame:
        return tokens.build_dictionary(self.early_sales, order_key="customer_key")

    @cached_property
    def grown_dictionary(self) -> DataFrame:
        return tokens.build_dictionary(
            self.sales, order_key="customer_key", previous=self.early_dictionary
        )

    @cached_property
    def run(self) -> RiskRun:
        return RiskRun(self.sales, order_key="customer_key")

    @cached_property
    def named(self) -> DataFrame:
        """Sales with a usable name. Names are grouping keys; few rows are masked after summing."""
        return tokens.split_by_name(self.sales)[0]

    @cached_property
    def named_totals(self) -> DataFrame:
        return periods.period_totals(self.named, ["customer_name"])

    @cached_property
    def named_trends(self) -> DataFrame:
        return periods.period_trends(self.named_totals, ["customer_name"])

    def mask(self, summed: DataFrame) -> DataFrame:
        return tokens.mask(summed, self.dictionary)

    @cached_property
    def totals(self) -> DataFrame:
        return self.mask(self.named_totals)

    @cached_property
    def trends(self) -> DataFrame:
        return self.mask(self.named_trends)

    @cached_property
    def metrics(self) -> DataFrame:
        return self.mask(periods.customer_metrics(self.named_trends, ["customer_name"]))

    @cached_property
    def dirty_sales(self) -> DataFrame:
        """The sales with the gaps their sources suggest: unspecified terms,
        accounts in debt without a name, samples without a price, numbers out of range."""
        named = warehouse_sales(self.spark, self.directory)
        accounts = warehouse_table(self.spark, self.directory, "customer")
        return named.join(
            accounts.select(F.col("c_custkey").alias("customer_key"), "c_acctbal"), "customer_key"
        ).select(
            "customer_key",
            "transaction_date",
            F.when(F.col("c_acctbal") < 0, "   ").otherwise(F.col("customer_name")).alias("customer_name"),
            F.when(F.col("category") == "PROMO", F.repeat("category", F.lit(21)))
            .otherwise(F.col("category"))
            .alias("category"),
            F.when(F.col("quantity") < 50, F.col("quantity")).alias("quantity"),
            F.when(F.col("quantity") == 1, 0.0)
            .when(F.col("quantity") == 3, float("inf"))
            .otherwise(F.col("unit_sales_price"))
            .alias("unit_sales_price"),
            F.when(F.col("quantity") == 2, float("nan")).otherwise(F.col("unit_cost")).alias("unit_cost"),
            F.when(F.col("payment_term") != "Net 45", F.col("payment_term")).alias("payment_term"),
        )

    @cached_property
    def finding_json(self) -> DataFrame:
        """Findings as JSON records, spoiled in a different way per severity and type."""
        rows = self.run.findings
        fields = [f.name for f in schemas.FINDING.fields]

        def record(**changed: Column | None) -> Column:
            kept = [changed.get(n, F.col(n)) for n in fields]
            return F.to_json(
                F.struct(*[c.alias(n) for n, c in zip(fields, kept) if c is not None])
            )

        severity, kind = F.col("severity"), F.col("risk_type")
        raw = (
            F.when(severity == "CRITICAL", record(metric_value=F.col("metric_value").cast("string")))
            .when(severity == "HIGH", record())
            .when(severity == "MEDIUM", record(evidence=None, metric_value=F.lit("many")))
            .when(kind == "MARGIN_RISK", F.substring(record(), 1, 20))
            .otherwise(record(severity=F.lit("SEVERE"), customer_id=F.col("pos")))
        )
        return store(rows.select(F.col("customer_id").alias("key"), raw.alias("raw")), "records")


_desks: dict[tuple[str, str], Desk] = {}


def desk(spark: SparkSession, directory: str) -> Desk:
    name = (spark.sparkContext.applicationId, directory)
    if name not in _desks:
        _desks[name] = Desk(spark, directory)
    return _desks[name]


def forget_desks() -> None:
    """Make the next query start from the files again."""
    _desks.clear()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a function from a desk to a result."""

    def register(build: Callable[[Desk], DataFrame]):
        QUERIES[name] = lambda spark, directory: build(desk(spark, directory))
        return build

    return register


def six(column: str) -> Column:
    """Six decimals of a sum or a quotient of sums.

    Dividing amounts by even quantities often ends exactly between two sixth
    decimals. The small shift keeps the order of summation from deciding those.
    """
    return F.round(F.col(column) + F.lit(1e-9), 6).alias(column)


def day(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def sales_columns() -> list[Column]:
    return [
        F.col("customer_name"),
        day("transaction_date"),
        F.col("category"),
        F.col("quantity"),
        F.col("unit_sales_price"),
        F.col("unit_cost"),
        F.col("payment_term"),
    ]


def steps_text() -> Column:
    return F.array_join("action_steps", "\n").alias("action_steps")


def or_none() -> Column:
    return F.coalesce("risk_type", F.lit("NONE")).alias("risk_type")


# --- sources and sinks ---------------------------------------------------------


@query("S1_sales_scan")
def _(d: Desk) -> DataFrame:
    return d.sales.select(*sales_columns())


@query("S2_contract")
def _(d: Desk) -> DataFrame:
    valid, rejected = quality.enforce_contract(d.dirty_sales)
    both = rejected.withColumn("reasons", F.array_join("reasons", ",")).unionByName(
        valid.withColumn("reasons", F.lit(""))
    )
    return both.groupBy("reasons").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity")
    )


@query("S3_raw_ingest")
def _(d: Desk) -> DataFrame:
    path = fresh_path(d.spark, "raw")
    headers = {name: header for header, name in schemas.RAW_HEADERS.items()}
    d.sales.select(
        *[F.col(name).alias(header) for name, header in headers.items()]
    ).write.option("header", True).csv(path)
    return raw_files.read_raw(d.spark, path).select(*sales_columns())


@query("S3_unreadable_lines")
def _(d: Desk) -> DataFrame:
    """Raw files in which some quantities are words and some lines are cut off; what is wrong, by reason."""
    path = fresh_path(d.spark, "raw")
    headers = {name: header for header, name in schemas.RAW_HEADERS.items()}
    values = {name: F.col(name).cast("string") for name in headers}
    values["quantity"] = F.when(F.col("quantity") == 7, "seven").otherwise(values["quantity"])
    values["transaction_date"] = F.when(F.col("quantity") == 8, "soon").otherwise(values["transaction_date"])
    whole = F.concat_ws(",", *[values[name] for name in headers])
    line = F.when(F.col("quantity") == 9, F.concat_ws(",", "customer_name", "category")).otherwise(whole)
    d.sales.select(line.alias("value")).write.text(path)
    return (
        raw_files.unreadable(d.spark, path, header=False)
        .select("line", F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("rows"), F.countDistinct(F.substring_index("line", ",", -1)).alias("endings"))
    )


@query("S1_sales_by_customer")
def _(d: Desk) -> DataFrame:
    """Sums of sales that are kept bucketed by customer; no line of them is shuffled."""
    name = f"sales_by_customer_{uuid.uuid4().hex}"
    kept = sales_table.save_by_customer(d.sales, name, fresh_path(d.spark, "by-customer"), 8)
    return periods.unit_values(periods.period_totals(kept, ["customer_name"])).select(
        "customer_name", day("period"), "quantity", six("unit_price"), six("unit_cost")
    )


@query("S4_load_once")
def _(d: Desk) -> DataFrame:
    path = fresh_path(d.spark, "table")
    for _again in range(2):
        sales_table.load_if_empty(d.sales, path)
    return (
        d.spark.read.schema(d.sales.schema)
        .parquet(path)
        .groupBy("payment_term")
        .agg(F.count("*").alias("rows"))
    )


@query("S5_default_rows")
def _(d: Desk) -> DataFrame:
    path = fresh_path(d.spark, "table")
    d.sales.limit(0).write.parquet(path)
    loaded = sales_table.load_or_default(d.spark, path, d.sales)
    return loaded.groupBy("category").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("quantity")
    )


@query("S6_input_check")
def _(d: Desk) -> DataFrame:
    return sales_table.check_input(d.sales).groupBy("payment_term").agg(
        F.sum("quantity").alias("quantity")
    )


@query("S7_output_sinks")
def _(d: Desk) -> DataFrame:
    """All outputs of a run over spoiled sales, written, named ones apart; a digest of every row read back."""
    path, named = fresh_path(d.spark, "outputs"), fresh_path(d.spark, "named-outputs")
    outputs = RiskRun(d.dirty_sales, order_key="customer_key").outputs()
    sales_table.write_outputs(outputs, path, named)

    def read_back(name: str) -> DataFrame:
        folder = named if name in sales_table.NAMED_OUTPUTS else path
        rows = d.spark.read.schema(outputs[name].schema).parquet(f"{folder}/{name}")
        if name == "inbox":
            rows = rows.drop("severity_tag", "risk_label", "metric_label", "metric_text", "metric_note")
        part = F.col("risk_type") if name == "findings" else F.lit("")
        kept = rows.withColumn("part", part).select("part", *sorted(rows.columns))
        return sales_table.digest(kept, "part").select(F.lit(name).alias("output"), "part", "rows", "digest")

    return reduce(DataFrame.unionByName, [read_back(name) for name in outputs])


# --- tokens -----------------------------------------------------------------------


@query("M1_token_dictionary")
def _(d: Desk) -> DataFrame:
    return tokens.build_dictionary(d.sales, order_key="customer_key")


@query("M2_dictionary_extension")
def _(d: Desk) -> DataFrame:
    return d.grown_dictionary


@query("M3_mask")
def _(d: Desk) -> DataFrame:
    masked = tokens.mask(d.sales, d.dictionary)
    return masked.groupBy("customer_id").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("quantity")
    )


@query("M4_unmask")
def _(d: Desk) -> DataFrame:
    totals = tokens.mask(d.named_totals, d.grown_dictionary)
    named = tokens.unmask(totals, d.early_dictionary, strict=False)
    return named.select(
        "customer_id",
        F.coalesce("customer_name", F.lit("")).alias("customer_name"),
        day("period"),
        "quantity",
    )


@query("M4_unmask_strict")
def _(d: Desk) -> DataFrame:
    return tokens.unmask(d.run.findings, d.run.dictionary).select(
        "customer_id", "customer_name", "risk_type"
    )


@query("M5_unmask_text")
def _(d: Desk) -> DataFrame:
    token = F.col("token")
    text = F.concat(
        token, F.lit("\n"), token, F.lit("0 C X"), token, F.lit(", CUSTOMER_ / "), token, F.lit("1")
    )
    texts = d.grown_dictionary.select(F.col("token").alias("key"), text.alias("text"))
    return tokens.unmask_text(texts, d.early_dictionary, ["key"], ["text"])


@query("M6_name_check")
def _(d: Desk) -> DataFrame:
    named, rejected = tokens.split_by_name(d.dirty_sales)
    rows = named.withColumn("reason", F.lit("")).unionByName(rejected)
    return rows.groupBy("reason").agg(
        F.count("*").alias("rows"), F.countDistinct("customer_key").alias("customers")
    )


@query("M7_prefix")
def _(d: Desk) -> DataFrame:
    suppliers = warehouse_table(d.spark, d.directory, "supplier")
    return tokens.build_dictionary(suppliers, "s_name", "s_suppkey", prefix="VENDOR")


@query("M8_export_map")
def _(d: Desk) -> DataFrame:
    return tokens.export_map(d.dictionary)


@query("M9_reset")
def _(d: Desk) -> DataFrame:
    """The early dictionary is replaced: a new token for each name, and whose the old token is now."""
    path = fresh_path(d.spark, "dictionary")
    d.early_dictionary.write.parquet(path)
    old = store(d.early_dictionary, "dictionary").select("name", F.col("token").alias("old_token"))
    fresh = tokens.reset_dictionary(d.sales, path, order_key="customer_key")
    owner = fresh.select(F.col("token").alias("old_token"), F.col("name").alias("now"))
    return (
        fresh.join(old.join(owner, "old_token", "left"), "name", "left")
        .select(
            "name", "token", "token_no",
            F.coalesce("old_token", F.lit("")).alias("old_token"),
            F.coalesce("now", F.lit("")).alias("old_token_now"),
        )
    )


@query("M10_leak_audit")
def _(d: Desk) -> DataFrame:
    """All texts with tokens, which hold no name, and all texts of the inbox, which do."""
    texts = quality.hand_on_texts(d.run.findings, d.run.strategies, d.run.messages)
    cards = d.run.inbox.withColumn("action_steps", steps_text())
    own = F.concat(F.lit("names/"), "customer_id", F.lit("/"))
    named = quality.texts_of(cards, own, "evidence", "rationale", "action_steps", "body")
    return leak_audit.leaks(store(texts.unionByName(named), "texts"), d.run.dictionary, ["key"])


@query("M11_masked_projection")
def _(d: Desk) -> DataFrame:
    return d.masked.select(
        "customer_id",
        day("transaction_date"),
        "category",
        "quantity",
        "unit_sales_price",
        "unit_cost",
        "payment_term",
    )


# --- projections --------------------------------------------------------------------


@query("P1_row_margin")
def _(d: Desk) -> DataFrame:
    margin = X.margin_pct(F.col("unit_sales_price"), F.col("unit_cost"))
    return d.masked.select(
        "customer_id", day("transaction_date"), "quantity", X.rounded(margin).alias("margin_pct")
    )


@query("P2_sale_line")
def _(d: Desk) -> DataFrame:
    return d.masked.select("customer_id", X.sale_line().alias("line"))


@query("P3_finding_line")
def _(d: Desk) -> DataFrame:
    return summaries.finding_lines(d.run.findings)


@query("P4_strategy_block")
def _(d: Desk) -> DataFrame:
    return summaries.strategy_blocks(d.run.strategies)


@query("P5_labels")
def _(d: Desk) -> DataFrame:
    return d.run.cards.select("customer_id", "severity_tag", "risk_label")


@query("P6_metric_text")
def _(d: Desk) -> DataFrame:
    return d.run.cards.select("customer_id", "metric_label", "metric_text", "metric_note")


@query("P7_share_link")
def _(d: Desk) -> DataFrame:
    chats = d.run.messages.where(F.col("channel") == "WHATSAPP")
    return chats.select("customer_id", X.share_link(F.col("body")).alias("share_link"))


@query("P8_strategy_defaults")
def _(d: Desk) -> DataFrame:
    some = d.run.strategies.where(F.col("risk_type") == "BOTH")
    return inbox.cards(d.run.findings, some, d.run.messages).select(
        "customer_id", "strategy_title", "rationale", steps_text()
    )


@query("P9_placeholder")
def _(d: Desk) -> DataFrame:
    return d.dictionary.select(
        F.col("token").alias("customer_id"), playbook.placeholder(F.col("token")).alias("placeholder")
    )


# --- filters ----------------------------------------------------------------------------


@query("F1_at_risk")
def _(d: Desk) -> DataFrame:
    return risk.at_risk(risk.classify(d.run.metrics)).select("customer_id", "risk_type", "periods")


@query("F2_channel_filter")
def _(d: Desk) -> DataFrame:
    return d.run.messages.where(F.col("channel") == "WHATSAPP").select(
        "customer_id", "channel", "tone"
    )


@query("F3_empty_findings")
def _(d: Desk) -> DataFrame:
    calm = RiskConfig(
        two_period_drop_pct=1e9, single_period_drop_pct=1e9, min_margin=-1e9, growth_gap_points=1e9
    )
    findings = risk.findings(d.run.metrics, calm)
    strategies = playbook.strategies(findings)
    texts = [
        summaries.analysis_summary(findings),
        summaries.strategy_summary(strategies),
        summaries.finding_lines(findings).select("line"),
        summaries.strategy_blocks(strategies).select("line"),
    ]
    lines = [df.toDF("line") for df in texts]
    return lines[0].unionByName(lines[1]).unionByName(lines[2]).unionByName(lines[3])


# --- aggregations -----------------------------------------------------------------------


@query("A1_row_count")
def _(d: Desk) -> DataFrame:
    return summaries.row_count(d.named)


@query("A2_distinct_customers")
def _(d: Desk) -> DataFrame:
    return summaries.load_counts(d.named, "customer_name").select("customers")


@query("A3_context_blocks")
def _(d: Desk) -> DataFrame:
    return summaries.context_blocks(d.masked, block_lines=25)


@query("A4_period_totals")
def _(d: Desk) -> DataFrame:
    return periods.unit_values(d.totals).select(
        "customer_id", day("period"), "quantity", six("unit_price"), six("unit_cost")
    )


@query("A4_month_and_category")
def _(d: Desk) -> DataFrame:
    totals = periods.period_totals(d.named, ["customer_name", "category"], "month")
    return d.mask(totals).select("customer_id", "category", day("period"), "quantity", six("revenue"))


@query("A5_period_spine")
def _(d: Desk) -> DataFrame:
    filled = periods.fill_periods(store(d.totals, "totals"))
    return filled.select("customer_id", day("period"), "quantity", six("revenue"))


@query("A6_first_last")
def _(d: Desk) -> DataFrame:
    return d.metrics.select(
        "customer_id",
        six("first_price"),
        six("last_price"),
        six("first_cost"),
        six("last_cost"),
        "cost_growth_pct",
        "price_growth_pct",
    )


@query("A7_margin_and_velocity")
def _(d: Desk) -> DataFrame:
    return d.mask(periods.margin_and_velocity(d.named, key="customer_name"))


@query("A8_first_seen_order")
def _(d: Desk) -> DataFrame:
    return inbox.customers_in_order(d.run.findings)


@query("A9_run_counts")
def _(d: Desk) -> DataFrame:
    return d.run.run_counts


@query("A10_risk_rollup")
def _(d: Desk) -> DataFrame:
    return summaries.risk_rollup(d.run.findings)


@query("A10_summaries")
def _(d: Desk) -> DataFrame:
    return (
        d.run.analysis_summary.toDF("summary")
        .unionByName(d.run.strategy_summary.toDF("summary"))
    )


# --- windows --------------------------------------------------------------------------------


@query("W1_period_order")
def _(d: Desk) -> DataFrame:
    return d.trends.select(
        "customer_id",
        day("period"),
        "quantity",
        F.coalesce("previous_quantity", F.lit(-1)).alias("previous_quantity"),
        F.coalesce("earlier_quantity", F.lit(-1)).alias("earlier_quantity"),
    )


@query("W2_single_drop")
def _(d: Desk) -> DataFrame:
    return d.trends.select("customer_id", day("period"), "single_drop")


@query("W3_two_period_drop")
def _(d: Desk) -> DataFrame:
    return d.trends.select("customer_id", day("period"), "two_drop")


@query("W4_current_period")
def _(d: Desk) -> DataFrame:
    return d.metrics.select(
        "customer_id", "periods", day("current_period"), "current_quantity", "current_margin"
    )


@query("W5_growth_gap")
def _(d: Desk) -> DataFrame:
    return d.mask(periods.growth_trends(d.named_trends, ["customer_name"])).select(
        "customer_id", day("period"), "cost_growth_pct", "price_growth_pct", "growth_gap"
    )


# --- risk, strategy, messages ---------------------------------------------------------------


@query("R1_churn")
def _(d: Desk) -> DataFrame:
    return risk.classify(d.run.metrics).select(
        "customer_id", "two_period_drop", "max_single_drop", "churn"
    )


@query("R2_margin")
def _(d: Desk) -> DataFrame:
    return risk.classify(d.run.metrics).select(
        "customer_id", "current_margin", "growth_gap", "margin"
    )


@query("R3_risk_type")
def _(d: Desk) -> DataFrame:
    return risk.classify(d.run.metrics).select("customer_id", or_none())


@query("R3_latest_drop_scope")
def _(d: Desk) -> DataFrame:
    latest = RiskConfig(drop_scope="latest")
    return risk.findings(d.run.metrics, latest).select(
        "customer_id", "risk_type", "severity", "metric_value"
    )


@query("R3_category_grain")
def _(d: Desk) -> DataFrame:
    config = RiskConfig(grain=("category",))
    metrics = named_metrics(d.sales, config, "customer_key")
    return risk.classify(metrics, config).select("customer_name", "category", or_none())


@query("R3_filled_months")
def _(d: Desk) -> DataFrame:
    config = RiskConfig(period="month", fill_empty_periods=True)
    metrics = named_metrics(d.sales, config, "customer_key")
    return risk.classify(metrics, config).select("customer_name", "periods", or_none())


@query("R4_severity")
def _(d: Desk) -> DataFrame:
    return d.run.findings.select("customer_id", "severity")


@query("R5_metric_value")
def _(d: Desk) -> DataFrame:
    return d.run.findings.select("customer_id", "metric_value")


@query("R6_evidence")
def _(d: Desk) -> DataFrame:
    return d.run.findings.select("customer_id", "evidence")


@query("R7_strategies")
def _(d: Desk) -> DataFrame:
    return d.run.strategies.select("customer_id", "strategy_title", "rationale", steps_text())


@query("R8_priority")
def _(d: Desk) -> DataFrame:
    return d.run.strategies.select("customer_id", "priority")


@query("R9_drafts")
def _(d: Desk) -> DataFrame:
    return d.run.messages.select("customer_id", "channel", "subject", "body", "tone")


@query("R10_length_check")
def _(d: Desk) -> DataFrame:
    return d.run.messages.select("customer_id", "channel", "words", "length_ok")


@query("R11_routing")
def _(d: Desk) -> DataFrame:
    return playbook.routed(d.run.findings).select("customer_id", "queue")


# --- joins and order ---------------------------------------------------------------------------


@query("J1_cards")
def _(d: Desk) -> DataFrame:
    cards = inbox.cards(d.run.findings, d.run.strategies, d.run.messages)
    return cards.select(
        "customer_id", "risk_type", "severity", "metric_value", "priority", "strategy_title", "body"
    )


@query("J2_named_inbox")
def _(d: Desk) -> DataFrame:
    return d.run.inbox.select(
        "customer_id",
        "customer_name",
        "evidence",
        "strategy_title",
        "rationale",
        steps_text(),
        "body",
        "share_link",
    )


@query("J3_coverage")
def _(d: Desk) -> DataFrame:
    strategies = d.run.strategies
    spoiled = strategies.where(F.col("risk_type") != "MARGIN_RISK").unionByName(
        strategies.where(F.col("priority") == "URGENT")
    )
    chats = d.run.messages.where((F.col("channel") == "EMAIL") | (F.col("tone") == "URGENT"))
    return inbox.coverage_gaps(d.run.findings, spoiled, chats).withColumn(
        "problems", F.array_join("problems", ",")
    )


@query("J3_coverage_by_category")
def _(d: Desk) -> DataFrame:
    """Several findings a customer: one has two strategies, another of the same customer has none."""
    grain = ("category",)
    run = RiskRun(d.sales, RiskConfig(grain=grain), order_key="customer_key")
    strategies = run.strategies
    spoiled = strategies.where(F.col("category") != "PROMO").unionByName(
        strategies.where(F.col("category") == "ECONOMY")
    )
    return inbox.coverage_gaps(run.findings, spoiled, run.messages, grain).withColumn(
        "problems", F.array_join("problems", ",")
    )


@query("U1_accumulate")
def _(d: Desk) -> DataFrame:
    return quality.accumulate(
        ("findings", d.run.findings.select("customer_id", "pos")),
        ("strategies", d.run.strategies.select("customer_id", "pos")),
        ("messages", d.run.messages.select("customer_id", "pos")),
    )


@query("U2_last_write")
def _(d: Desk) -> DataFrame:
    return quality.last_write(d.totals, "customer_id", "quantity", "period")


@query("U3_errors")
def _(d: Desk) -> DataFrame:
    """The errors of a run over spoiled sales, and those of spoiled records and unknown tokens."""
    _, bad_json = quality.validate_json(d.finding_json, schemas.FINDING, keep=("key",))
    strangers = tokens.unknown_tokens(
        d.grown_dictionary.select(F.col("token").alias("customer_id")), d.early_dictionary
    )
    errors = (
        RiskRun(d.dirty_sales, order_key="customer_key")
        .errors.unionByName(quality.as_errors(bad_json, "findings", F.col("key")))
        .unionByName(quality.as_errors(strangers, "unmask", F.col("customer_id")))
    )
    return errors.groupBy("step", "reason").agg(
        F.count("*").alias("rows"), F.countDistinct("key").alias("keys")
    )


@query("U3_failed_step")
def _(d: Desk) -> DataFrame:
    """A run whose drafts fail: rows of each output, and what its errors say."""

    def fails(strategies: DataFrame) -> DataFrame:
        return strategies.withColumn("body", F.raise_error(F.lit("no drafts")))

    outputs = run_in_steps(
        d.sales, fresh_path(d.spark, "steps"), order_key="customer_key", changed={"messages": fails}
    )
    errors = outputs.pop("errors")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows") for name, df in outputs.items()]
    said = F.concat_ws(" ", F.col("step"), F.substring_index("reason", " ", 1))
    counts.append(errors.groupBy(said.alias("output")).agg(F.count("*").alias("rows")))
    return reduce(DataFrame.unionByName, counts)


@query("O1_most_urgent")
def _(d: Desk) -> DataFrame:
    return inbox.most_urgent(d.run.cards, 25).select("customer_id", "severity", "metric_value")


# --- JSON records ----------------------------------------------------------------------------


@query("V1_findings")
def _(d: Desk) -> DataFrame:
    valid, _ = quality.validate_json(d.finding_json, schemas.FINDING, keep=("key",))
    return valid


@query("V1_rejected_findings")
def _(d: Desk) -> DataFrame:
    _, rejected = quality.validate_json(d.finding_json, schemas.FINDING, keep=("key",))
    return rejected.withColumn("reasons", F.array_join("reasons", ","))


@query("V1_strategies")
def _(d: Desk) -> DataFrame:
    fields = [f.name for f in schemas.STRATEGY.fields]
    steps = F.when(F.col("risk_type") == "BOTH", F.lit("one step"))
    listed = F.to_json(F.struct(*fields))
    as_text = F.to_json(
        F.struct(*[F.lit("one step").alias(n) if n == "action_steps" else F.col(n) for n in fields])
    )
    with_gap = F.to_json(
        F.struct(
            *[
                F.array(F.lit("first"), F.lit(None).cast("string")).alias(n) if n == "action_steps" else F.col(n)
                for n in fields
            ]
        )
    )
    spoiled = F.when(steps.isNotNull(), as_text).otherwise(with_gap)
    record = F.array(
        F.struct(F.col("customer_id").alias("key"), listed.alias("raw")),
        F.struct(F.concat(F.lit("bad/"), "customer_id").alias("key"), spoiled.alias("raw")),
    )
    rows = d.run.strategies.select(F.inline(record))
    valid, rejected = quality.validate_json(rows, schemas.STRATEGY, keep=("key",))
    return valid.select(
        "key", "strategy_title", F.size("action_steps").alias("steps"), F.lit("").alias("reasons")
    ).unionByName(
        rejected.select(
            "key",
            F.lit("").alias("strategy_title"),
            F.lit(0).alias("steps"),
            F.array_join("reasons", ",").alias("reasons"),
        )
    )


@query("V1_messages")
def _(d: Desk) -> DataFrame:
    full = F.to_json(F.struct("customer_id", "channel", "subject", "body", "tone"))
    short = F.to_json(F.struct("customer_id", "channel", "body", "tone"))
    raw = F.when(F.col("channel") == "EMAIL", full).otherwise(short)
    rows = d.run.messages.select(F.col("pos").alias("key"), raw.alias("raw"))
    valid, _ = quality.validate_json(rows, schemas.MESSAGE, keep=("key",))
    return valid


@query("V2_reports")
def _(d: Desk) -> DataFrame:
    record = F.struct(*[f.name for f in schemas.FINDING.fields])
    summary = F.min_by("risk_type", "pos").alias("summary")
    severity = F.min_by("severity", "pos")
    listed = F.collect_list(record).alias("findings")
    whole = F.to_json(F.struct(listed, summary))
    spoiled = (
        F.when(severity == "HIGH", F.substring(whole, 1, 20))
        .when(severity == "MEDIUM", F.to_json(F.struct(F.lit("none").alias("findings"), summary)))
        .otherwise(F.to_json(F.struct(listed)))
    )
    wrapped = d.run.findings.groupBy("customer_id").agg(whole.alias("sound"), spoiled.alias("spoiled"))
    reports = wrapped.select(
        F.inline(
            F.array(
                F.struct(F.col("customer_id").alias("key"), F.col("sound").alias("raw")),
                F.struct(F.concat(F.lit("bad/"), "customer_id").alias("key"), F.col("spoiled").alias("raw")),
            )
        )
    )
    items, notes, broken = quality.unwrap_reports(reports, "findings", "summary", keep=("key",))
    valid, _ = quality.validate_objects(items, schemas.FINDING, keep=("key", "item_no"))
    columns = ["key", "item_no", "severity", "metric_value", "summary", "reasons"]
    rejected = broken.select(
        "key",
        F.lit(-1).alias("item_no"),
        F.lit("").alias("severity"),
        F.lit(0.0).alias("metric_value"),
        F.lit("").alias("summary"),
        F.array_join("reasons", ",").alias("reasons"),
    )
    return valid.join(notes, "key").withColumn("reasons", F.lit("")).select(columns).unionByName(rejected)


@query("V3_token_check")
def _(d: Desk) -> DataFrame:
    by_name = d.sales.groupBy("customer_name").agg(F.count("*").alias("rows"))
    rows = tokens.mask(by_name, d.grown_dictionary).select("customer_id", "rows")
    return tokens.unknown_tokens(rows, d.early_dictionary)


# --- streaming ------------------------------------------------------------------------------


def numbered_sales(d: Desk) -> DataFrame:
    """The sales with record ids, from a table in order of time, of which an arrival reads its own part."""
    order = ["transaction_date", "customer_key", "category", "quantity", "unit_sales_price", "unit_cost"]
    rows = with_position(store(d.sales, "sales"), order, "id")
    return rows.select(*[f.name for f in schemas.SALES.fields])


def watched(d: Desk, config: RiskConfig, *arrivals: Callable[[DataFrame], DataFrame]) -> RiskMonitor:
    """A monitor that all sales have reached as a stream, a few files of each arrival at a time."""
    use_disk_state(d.spark)
    rows, folder = numbered_sales(d), fresh_path(d.spark, "arrivals")
    for arrival in arrivals:
        arrival(rows).write.mode("append").parquet(folder)
    monitor = RiskMonitor(d.spark, fresh_path(d.spark, "monitor"), config)
    monitor.start(count_once(sales_stream(d.spark, folder, files_per_batch=10))).awaitTermination()
    return monitor


def between(first: str, last: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(F.col("transaction_date").between(first, last))


OLDEST, MIDDLE, NEWEST = (
    between("0001-01-01", "1996-12-31"),
    between("1997-01-01", "1999-06-30"),
    between("1999-07-01", "9999-12-31"),
)


def twice(arrival: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: arrival(rows).unionByName(arrival(rows))


@query("ST1_risk_monitor")
def _(d: Desk) -> DataFrame:
    """Findings from the state, after the newest third came first and twice."""
    monitor = watched(d, RiskConfig(), twice(NEWEST), MIDDLE, OLDEST)
    named = tokens.unmask(monitor.findings(), monitor.dictionary())
    return named.select("customer_name", "risk_type", "severity", "metric_value")


@query("ST1_silent_customers")
def _(d: Desk) -> DataFrame:
    """What the batches changed, by months: customers without new orders come up as months pass."""
    monitor = watched(d, RiskConfig(period="month", fill_empty_periods=True), OLDEST, MIDDLE, NEWEST)
    return latest(monitor.changes()).select("customer_name", "periods", or_none())


@query("ST1_live_inbox")
def _(d: Desk) -> DataFrame:
    """The inbox that the changes of all batches add up to; cards of customers who recovered are withdrawn."""
    monitor = watched(d, RiskConfig(), OLDEST, NEWEST, MIDDLE)
    return latest(monitor.changes()).where("holds").select(
        "customer_name", "evidence", "strategy_title", "rationale", steps_text(), "body", "share_link"
    )


@query("ST2_count_once")
def _(d: Desk) -> DataFrame:
    """Events sent twice, in two folders of one stream; sums must count each once."""
    use_disk_state(d.spark)
    folder = fresh_path(d.spark, "events")
    events = warehouse_table(d.spark, d.directory, "events")
    events.write.parquet(folder)
    events.write.mode("append").parquet(folder)
    state = fresh_path(d.spark, "once")
    stream = count_once(d.spark.readStream.schema(events.schema).parquet(folder), "event_id")
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{state}/kept")
        .awaitTermination()
    )
    kept = d.spark.read.schema(events.schema).parquet(f"{state}/kept")
    return kept.groupBy("event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")
    )
