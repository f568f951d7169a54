"""Column builders. Everything stays in JVM code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fixed

# A character that Python's ``str.strip`` would keep: anything outside Unicode
# white space and the four ASCII separators.
VISIBLE_CHARACTER = r"(?U)[^\s\x1c-\x1f]"


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text (M6).

    Most names start with a printable ASCII character, which is a cheap test;
    the pattern decides about the others.
    """
    visible = F.ascii(text).between(33, 126) | text.rlike(VISIBLE_CHARACTER)
    return text.isNull() | ~visible


def lookup(code: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Small fixed map lookup; an unknown code gives ``default``, else itself (P5)."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    found = F.try_element_at(F.create_map(*pairs), code)
    return F.coalesce(found, code if default is None else default)


def decimal_text(value: Column, places: int) -> Column:
    """A double with a fixed number of decimals, as ``{:.nf}`` prints it.

    The exact binary value decides, and a true tie goes to the even digit.
    ``F.round`` would round the shortest decimal that reads back as the double,
    which differs on about one price in three hundred. Shifting the point can
    itself round onto a tie; the lost part, kept exactly by splitting the
    double into two halves, then tells the direction.
    """
    power = float(10**places)
    shifted = value * power
    spread = value * 134217729.0
    high = spread - (spread - value)
    lost = (high * power - shifted) + (value - high) * power
    nudge = F.when(F.abs(shifted) % 1 == 0.5, F.signum(lost) * 0.25).otherwise(0.0)
    return F.call_function(
        "format_number", F.rint(shifted + nudge) / power, F.lit("0." + "0" * places)
    )


def margin_ratio(price: Column, cost: Column) -> Column:
    """Gross margin as a ratio; NULL for a zero price."""
    return F.try_divide(price - cost, price)


def margin_pct(price: Column, cost: Column) -> Column:
    """Gross margin in percent."""
    return margin_ratio(price, cost) * 100


def sale_line() -> Column:
    """One sale as a line of text."""
    price, cost = F.col("unit_sales_price"), F.col("unit_cost")
    return F.concat(
        F.lit("  "),
        F.col("transaction_date").cast("string"),
        F.lit(" | Category: "),
        F.col("category"),
        F.lit(" | Qty: "),
        F.col("quantity").cast("string"),
        F.lit(" | Price: "),
        decimal_text(price, 2),
        F.lit(" TRY | Cost: "),
        decimal_text(cost, 2),
        F.lit(" TRY | Margin: "),
        decimal_text(margin_pct(price, cost), 1),
        F.lit("%"),
    )


def finding_line() -> Column:
    """One finding as a line of text."""
    return F.concat(
        F.lit("- "),
        F.col("customer_id"),
        F.lit(" | "),
        F.col("risk_type"),
        F.lit(" | Severity: "),
        F.col("severity"),
        F.lit(" | Metric: "),
        decimal_text(F.col("metric_value"), 3),
        F.lit(" | Evidence: "),
        F.col("evidence"),
    )


def numbered_steps(steps: Column, indent: str = "    ") -> Column:
    """Ordered steps as lines numbered from 1."""
    return F.array_join(
        F.transform(
            steps,
            lambda step, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". "), step),
        ),
        "\n",
    )


def strategy_block() -> Column:
    """One strategy as a block of text with numbered steps."""
    return F.concat(
        F.lit("Customer: "),
        F.col("customer_id"),
        F.lit("\nRisk: "),
        F.col("risk_type"),
        F.lit(" | Priority: "),
        F.col("priority"),
        F.lit("\nStrategy: "),
        F.col("strategy_title"),
        F.lit("\nRationale: "),
        F.col("rationale"),
        F.lit("\nAction Steps:\n"),
        numbered_steps(F.col("action_steps")),
    )


def metric_label(risk_type: Column) -> Column:
    """Caption of the metric; anything but the two single risks is a score."""
    return lookup(risk_type, fixed.METRIC_LABELS, F.lit(fixed.METRIC_LABELS["BOTH"]))


def metric_text(risk_type: Column, value: Column) -> Column:
    """Churn as percent, a margin below 1 as percent, all else as a number."""
    return (
        F.when(risk_type == "CHURN_RISK", F.concat(F.lit("%"), decimal_text(value, 1)))
        .when(
            (risk_type == "MARGIN_RISK") & (value < 1),
            F.concat(F.lit("%"), decimal_text(value * 100, 1)),
        )
        .otherwise(decimal_text(value, 1))
    )


def metric_note(risk_type: Column, value: Column) -> Column:
    """The small note under the metric."""
    return (
        F.when(risk_type == "CHURN_RISK", F.concat(F.lit("-%"), decimal_text(value, 1)))
        .when(risk_type == "MARGIN_RISK", F.lit(fixed.MARGIN_NOTE))
        .otherwise(F.lit(fixed.SCORE_NOTE))
    )


def severity_tag(severity: Column) -> Column:
    """P5: icon and label of a severity."""
    return F.concat(
        F.lit("["),
        lookup(severity, fixed.SEVERITY_ICONS, F.lit(fixed.DEFAULT_ICON)),
        F.lit(" "),
        lookup(severity, fixed.SEVERITY_LABELS),
        F.lit(" Risk]"),
    )


def percent_encoded(text: Column) -> Column:
    """Percent encoding of a URL part in which only ``/`` stays as it is.

    ``url_encode`` writes form encoding, which differs in four characters.
    """
    encoded = F.url_encode(text)
    for form, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(form), F.lit(wanted))
    return encoded


def share_link(body: Column) -> Column:
    """Link that opens a chat with the text filled in; NULL without a text."""
    return F.concat(F.lit(fixed.SHARE_PREFIX), percent_encoded(body))


def word_count(text: Column) -> Column:
    """Words separated by any white space."""
    return F.when(is_blank(text), F.lit(0)).otherwise(
        F.size(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"))
    )


def rounded(value: Column) -> Column:
    """Six decimals: what thresholds compare, equal on every engine."""
    return F.round(value, 6)
