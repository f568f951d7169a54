"""S3: raw sales files with display headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import RAW, RAW_HEADERS, SALES

_LINE, _FILE = "_line", "_file"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV files under canonical names and types.

    A value that does not parse becomes NULL and is caught by the contract;
    ``unreadable`` has its text.
    """
    raw = spark.read.schema(RAW).option("header", True).csv(path)
    return to_sales(raw)


def typed(header: str) -> Column:
    """A raw value in the type of its column, NULL if it has none."""
    name = RAW_HEADERS[header]
    if name == "transaction_date":
        return F.try_to_date(F.col(header), "yyyy-MM-dd")
    return F.col(header).try_cast(SALES[name].dataType)


def to_sales(raw: DataFrame) -> DataFrame:
    return raw.select(*[typed(header).alias(name) for header, name in RAW_HEADERS.items()])


def unreadable(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``file, line, reasons`` of lines with too few or too many values, or with a value that does not parse.

    The line is the text as it stands in the file, or its values where the line
    itself is sound. Only these lines leave the scan.
    """
    fields = T.StructType([*RAW.fields, T.StructField(_LINE, T.StringType())])
    raw = (
        spark.read.schema(fields)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .csv(path)
        .withColumn(_FILE, F.col("_metadata.file_name"))
    )
    broken = F.col(_LINE).isNotNull()
    unread = {header: F.col(header).isNotNull() & typed(header).isNull() for header in RAW_HEADERS}
    reasons = [F.when(broken, "BROKEN_LINE")]
    reasons += [F.when(~broken & test, f"UNREADABLE_{RAW_HEADERS[header].upper()}") for header, test in unread.items()]
    values = F.concat_ws(",", *[F.coalesce(F.col(header), F.lit("")) for header in RAW_HEADERS])
    found = raw.select(
        F.col(_FILE).alias("file"), F.coalesce(_LINE, values).alias("line"), F.array_compact(F.array(*reasons)).alias("reasons")
    )
    return found.where(F.size("reasons") > 0)
