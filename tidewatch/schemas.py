"""Column contracts. Files are always read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SALES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("transaction_date", T.DateType(), False),
        T.StructField("customer_name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("unit_sales_price", T.DoubleType(), False),
        T.StructField("unit_cost", T.DoubleType(), False),
        T.StructField("payment_term", T.StringType(), False),
    ]
)

# What every step after loading needs; ``id`` may be absent.
SALES_REQUIRED = T.StructType([f for f in SALES.fields if f.name != "id"])

# Longest accepted text per column.
TEXT_LIMITS = {"customer_name": 255, "category": 100, "payment_term": 50}

# Display headers of raw files, in file order.
RAW_HEADERS = {
    "Date": "transaction_date",
    "Customer Name": "customer_name",
    "Category": "category",
    "Quantity": "quantity",
    "Unit Sales Price": "unit_sales_price",
    "Unit Cost": "unit_cost",
    "Payment Term": "payment_term",
}

RAW = T.StructType([T.StructField(header, T.StringType(), True) for header in RAW_HEADERS])

RISK_TYPES = ("CHURN_RISK", "MARGIN_RISK", "BOTH")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "URGENT")
CHANNELS = ("EMAIL", "WHATSAPP")
TONES = ("FORMAL", "FRIENDLY_PROFESSIONAL", "URGENT")

FINDING = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("risk_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
    ]
)

STRATEGY = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("risk_type", T.StringType()),
        T.StructField("strategy_title", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("action_steps", T.ArrayType(T.StringType())),
        T.StructField("priority", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("tone", T.StringType()),
    ]
)

ENUMS = {
    "risk_type": RISK_TYPES,
    "severity": SEVERITIES,
    "priority": PRIORITIES,
    "channel": CHANNELS,
    "tone": TONES,
}

ERROR = T.StructType(
    [
        T.StructField("step", T.StringType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("reason", T.StringType(), False),
    ]
)
