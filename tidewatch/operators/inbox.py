"""The action inbox."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.functions import fixed_values as fixed
from tidewatch.functions import wording
from tidewatch.operators import playbook
from tidewatch.operators.tokens import unmask_text

# Text columns of a card that may hold tokens.
CARD_TEXTS = ("evidence", "strategy_title", "rationale", "body")


def first_per_customer(df: DataFrame) -> DataFrame:
    """The row with the smallest ``pos`` of each customer.

    An aggregate instead of a ranking window: each task keeps one row per
    customer before the shuffle, however many rows a customer has.
    """
    rest = [c for c in df.columns if c not in ("customer_id", "pos")]
    return (
        df.groupBy("customer_id")
        .agg(F.min(F.struct("pos", *rest)).alias("row"))
        .select("customer_id", "row.*")
    )


def customers_in_order(findings: DataFrame) -> DataFrame:
    """Distinct customers by first appearance."""
    return findings.groupBy("customer_id").agg(F.min("pos").alias("pos"))


def cards(findings: DataFrame, strategies: DataFrame, messages: DataFrame) -> DataFrame:
    """One card per customer, tokens only.

    The three inputs are hashed by customer once each, for their aggregates;
    the two joins reuse that partitioning.
    """
    finding = first_per_customer(findings)
    strategy = first_per_customer(
        strategies.select("customer_id", "strategy_title", "rationale", "action_steps", "priority", "pos")
    ).drop("pos")
    chat = first_per_customer(
        messages.where(F.col("channel") == "WHATSAPP").select("customer_id", "body", "pos")
    ).drop("pos")
    return _card(
        finding.join(strategy, "customer_id", "left").join(chat, "customer_id", "left")
    )


def drafted_cards(findings: DataFrame, *keep: str) -> DataFrame:
    """J1 where each finding gets its strategy and draft from the playbook.

    Both follow from the finding alone, so the card is a projection of the
    first finding of each customer, without any join. ``keep`` names further
    columns that stay.
    """
    return _card(
        findings.withColumns(playbook.strategy_columns()).withColumn(
            "body", playbook.body(wording.CHAT_BODIES)
        ),
        *keep,
    )


def _card(joined: DataFrame, *keep: str) -> DataFrame:
    risk, value = F.col("risk_type"), F.col("metric_value")
    return joined.select(
        "customer_id",
        *keep,
        "pos",
        "risk_type",
        "severity",
        "metric_value",
        "priority",
        X.severity_tag(F.col("severity")).alias("severity_tag"),
        X.lookup(risk, fixed.RISK_LABELS).alias("risk_label"),
        X.metric_label(risk).alias("metric_label"),
        X.metric_text(risk, value).alias("metric_text"),
        X.metric_note(risk, value).alias("metric_note"),
        playbook.queue(F.col("severity")).alias("queue"),
        "evidence",
        F.coalesce("strategy_title", F.lit(fixed.NO_TITLE)).alias("strategy_title"),
        F.coalesce("rationale", F.lit(fixed.NO_RATIONALE)).alias("rationale"),
        F.coalesce("action_steps", F.array(F.lit(fixed.NO_STEP))).alias("action_steps"),
        "body",
    )


def named_cards(card_rows: DataFrame, dictionary: DataFrame, prefix: str = "CUSTOMER") -> DataFrame:
    """Cards with real names, the only output that carries them.

    The token of the card is looked up together with the tokens in its texts,
    so all names of a card arrive in one join. An unknown token keeps its place
    in the text; a card whose own token is unknown fails the job.
    """
    own = F.col("customer_id")
    restored = unmask_text(
        card_rows.withColumn("customer_name", own),
        dictionary,
        ["customer_id"],
        ["customer_name", *CARD_TEXTS],
        ["action_steps"],
        prefix,
    )
    missing = F.raise_error(F.concat(F.lit("unknown token "), own))
    return restored.withColumn(
        "customer_name",
        F.when(F.col("customer_name") == own, missing).otherwise(F.col("customer_name")),
    ).withColumn("share_link", X.share_link(F.col("body")))


def most_urgent(card_rows: DataFrame, k: int) -> DataFrame:
    """O1: the ``k`` most urgent cards. Each task keeps ``k`` rows only."""
    rank = X.lookup(F.col("severity"), fixed.SEVERITY_RANK, F.lit(0))
    return card_rows.orderBy(rank.desc(), F.desc("metric_value"), "customer_id").limit(k)


def coverage_gaps(
    findings: DataFrame, strategies: DataFrame, messages: DataFrame, grain: Sequence[str] = ()
) -> DataFrame:
    """Findings whose outputs do not match one to one.

    The key of a finding is its customer, ``grain`` and risk type, so two strategies
    for one finding do not make up for one without any. All three inputs are
    counted in one aggregation per key, in place of an anti join for each direction.
    """
    keys = ["customer_id", *grain, "risk_type"]
    parts = (
        findings.select(*keys, F.lit("finding").alias("part"))
        .unionByName(strategies.select(*keys, F.lit("strategy").alias("part")))
        .unionByName(messages.select(*keys, F.col("channel").alias("part")))
    )

    def number(part: str):
        return F.count_if(F.col("part") == part)

    counted = parts.groupBy(*keys).agg(
        number("finding").alias("findings"),
        number("strategy").alias("strategies"),
        number("EMAIL").alias("emails"),
        number("WHATSAPP").alias("chats"),
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("strategies") < F.col("findings"), "STRATEGY_MISSING"),
            F.when((F.col("findings") > 0) & (F.col("strategies") > F.col("findings")), "STRATEGY_EXTRA"),
            F.when((F.col("findings") == 0) & (F.col("strategies") > 0), "STRATEGY_ORPHAN"),
            F.when(F.col("emails") < F.col("strategies"), "EMAIL_MISSING"),
            F.when((F.col("strategies") > 0) & (F.col("emails") > F.col("strategies")), "EMAIL_EXTRA"),
            F.when(F.col("chats") < F.col("strategies"), "WHATSAPP_MISSING"),
            F.when((F.col("strategies") > 0) & (F.col("chats") > F.col("strategies")), "WHATSAPP_EXTRA"),
            F.when(
                (F.col("strategies") == 0) & (F.col("emails") + F.col("chats") > 0), "MESSAGE_ORPHAN"
            ),
        )
    )
    return counted.withColumn("problems", problems).where(F.size("problems") > 0)
