"""Sales rows derived from a star schema of orders, lines, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import lookup

# The columns used, so that nothing is inferred and nothing else is read.
TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_acctbal double",
    "supplier": "s_suppkey bigint, s_name string",
    "events": "event_id bigint, event_type string, value double",
}

PAYMENT_TERMS = {
    "1-URGENT": "Immediate",
    "2-HIGH": "Net 15",
    "3-MEDIUM": "Net 30",
    "4-NOT SPECIFIED": "Net 45",
    "5-LOW": "Net 60",
}


def warehouse_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}.parquet")


def warehouse_sales(spark: SparkSession, directory: str) -> DataFrame:
    """The sales columns plus ``customer_key``, one row per order line.

    The joins carry no hints: file sizes decide what Catalyst broadcasts. Orders
    meet customers before lines meet orders: rows as many as lines are shuffled
    by order and by part at most, never by customer, whose keys are skewed.
    """

    def table(name: str) -> DataFrame:
        return warehouse_table(spark, directory, name)

    bought = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        table("lineitem")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return rows.select(
        F.col("c_custkey").alias("customer_key"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("c_name").alias("customer_name"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (
            F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")
        ).alias("unit_sales_price"),
        (F.col("p_retailprice") * (1 + F.col("l_tax"))).alias("unit_cost"),
        lookup(F.col("o_orderpriority"), PAYMENT_TERMS).alias("payment_term"),
    )
