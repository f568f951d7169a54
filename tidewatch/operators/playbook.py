"""From findings to recommendations and drafts.

Texts come from small maps of constants, so no join is needed: a finding turns
into its strategy, and a strategy into its two drafts, by projection alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import wording
from tidewatch.functions.expressions import lookup, word_count
from tidewatch.functions.fixed_values import SEVERITY_PRIORITY


def placeholder(customer: Column, role: str = wording.READER_ROLE) -> Column:
    """Bracketed stand-in for the real name."""
    return F.concat(F.lit("["), customer, F.lit(f" {role}]"))


def priority(severity: Column) -> Column:
    """Priority that goes with a severity."""
    return lookup(severity, SEVERITY_PRIORITY)


def by_risk(texts: Mapping[str, str]) -> Column:
    return lookup(F.col("risk_type"), texts, F.lit(None).cast("string"))


def strategy_columns(playbook: Mapping[str, Mapping] = wording.PLAYBOOK) -> dict[str, Column]:
    """The columns of a recommendation, from the columns of a finding."""
    steps = F.create_map(
        *[
            part
            for risk, play in playbook.items()
            for part in (F.lit(risk), F.array(*[F.lit(step) for step in play["steps"]]))
        ]
    )
    return {
        "strategy_title": by_risk({risk: play["title"] for risk, play in playbook.items()}),
        "rationale": F.replace(
            by_risk({risk: play["rationale"] for risk, play in playbook.items()}),
            F.lit("{evidence}"),
            F.col("evidence"),
        ),
        "action_steps": F.transform(
            F.try_element_at(steps, F.col("risk_type")),
            lambda step: F.replace(step, F.lit("{customer}"), F.col("customer_id")),
        ),
        "priority": priority(F.col("severity")),
    }


def strategies(
    findings: DataFrame, playbook: Mapping[str, Mapping] = wording.PLAYBOOK, grain: Sequence[str] = ()
) -> DataFrame:
    """One recommendation per finding, under the key of the finding."""
    columns = strategy_columns(playbook)
    return findings.select(
        "customer_id", *grain, "risk_type", *[c.alias(name) for name, c in columns.items()], "pos"
    )


def body(texts: Mapping[str, str]) -> Column:
    """The draft for the risk type, addressed to the token."""
    return F.replace(
        by_risk(texts), F.lit("[{customer} {role}]"), placeholder(F.col("customer_id"))
    )


def messages(recommendations: DataFrame, grain: Sequence[str] = ()) -> DataFrame:
    """An e-mail and a chat draft per recommendation, under the key of its finding."""
    urgent = F.col("priority") == "URGENT"
    email = F.struct(
        F.lit("EMAIL").alias("channel"),
        by_risk(wording.SUBJECTS).alias("subject"),
        body(wording.EMAIL_BODIES).alias("body"),
        F.lit("FORMAL").alias("tone"),
        (F.col("pos") * 2 - 1).alias("pos"),
    )
    chat = F.struct(
        F.lit("WHATSAPP").alias("channel"),
        F.lit("").alias("subject"),
        body(wording.CHAT_BODIES).alias("body"),
        F.when(urgent, "URGENT").otherwise("FRIENDLY_PROFESSIONAL").alias("tone"),
        (F.col("pos") * 2).alias("pos"),
    )
    return recommendations.select("customer_id", *grain, "risk_type", F.inline(F.array(email, chat)))


def length_check(drafts: DataFrame) -> DataFrame:
    """Word count and whether it is inside the limits of the channel."""
    words = F.col("words")
    fits = F.lit(False)
    for channel, (low, high) in wording.WORD_LIMITS.items():
        fits = fits | ((F.col("channel") == channel) & words.between(low, high))
    return drafts.withColumn("words", word_count(F.col("body"))).withColumn("length_ok", fits)


def queue(severity: Column) -> Column:
    """Low risk goes ahead, everything else waits for a decision."""
    return F.when(severity == "LOW", "AUTO").otherwise("REVIEW")


def routed(findings: DataFrame) -> DataFrame:
    """Findings with their queue."""
    return findings.withColumn("queue", queue(F.col("severity")))
