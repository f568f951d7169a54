"""Small builders and plan readers shared by the tests."""

from datetime import date

from tidewatch.schemas import SALES


def sales_of(spark, rows):
    """Sales rows from ``(name, month, quantity, price, cost)`` in 2024."""
    full = [
        (i, date(2024, month, 1), name, "Kumaş", quantity, float(price), float(cost), "Net 30")
        for i, (name, month, quantity, price, cost) in enumerate(rows, 1)
    ]
    return spark.createDataFrame(full, SALES)


def names_of(spark, *names):
    return spark.createDataFrame(
        [(i, name) for i, name in enumerate(names, 1)], "id bigint, customer_name string"
    )


def token_map(dictionary):
    return {row["name"]: row["token"] for row in dictionary.collect()}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
