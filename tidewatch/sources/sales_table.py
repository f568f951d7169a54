"""The sales table, where it comes from and where results go."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import SALES, SALES_REQUIRED

# A pooled database of the reference size serves five connections.
_MAX_CONNECTIONS = 5


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales from Parquet, with the declared schema."""
    return spark.read.schema(SALES).parquet(path)


def jdbc_options(url: str) -> dict[str, str]:
    """Reader options from a database URL.

    ``postgres://`` and ``postgresql://`` become JDBC URLs; credentials move
    from the URL to options of their own.
    """
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    if parts.scheme.split("+")[0] not in ("postgres", "postgresql"):
        raise ValueError(f"unsupported database URL scheme {parts.scheme!r}")
    place = parts.hostname or ""
    if parts.port:
        place += f":{parts.port}"
    query = f"?{parts.query}" if parts.query else ""
    options = {"url": f"jdbc:postgresql://{place}{parts.path}{query}"}
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options


def read_sales_jdbc(
    spark: SparkSession,
    url: str,
    lower_id: int,
    upper_id: int,
    table: str = "sales_records",
    partitions: int = _MAX_CONNECTIONS,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Sales over JDBC, read in id ranges side by side.

    ``partitions`` is also the number of connections. The bounds only shape the
    ranges; ids outside them are read too.
    """
    return (
        spark.read.format("jdbc")
        .options(**jdbc_options(url))
        .option("dbtable", table)
        .option("partitionColumn", "id")
        .option("lowerBound", lower_id)
        .option("upperBound", upper_id)
        .option("numPartitions", partitions)
        .option("fetchsize", fetch_size)
        .load()
        .select(*SALES.fieldNames())
    )


def create_sales_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Create the table with its declared columns unless it exists."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()} NOT NULL" for f in SALES.fields)
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{location}")


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet path holds a row. A missing path holds none."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Write ``df`` only where no row exists yet. Returns whether it did."""
    if has_rows(df.sparkSession, path):
        return False
    df.write.mode("append").parquet(path)
    return True


def load_or_default(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """The table at ``path``; if it has no rows, load ``default`` there first."""
    load_if_empty(default, path)
    if not has_rows(spark, path):
        raise ValueError("the sales table is empty and so are the default rows")
    return spark.read.schema(default.schema).parquet(path)


def check_columns(sales: DataFrame) -> DataFrame:
    """A frame with the sales columns in their types. Runs no job."""
    if not isinstance(sales, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(sales).__name__}")
    present = {f.name: f.dataType for f in sales.schema.fields}
    for field in SALES_REQUIRED.fields:
        if field.name not in present:
            raise ValueError(f"missing column {field.name}")
        if present[field.name] != field.dataType:
            raise TypeError(
                f"column {field.name} must be {field.dataType.simpleString()}, "
                f"got {present[field.name].simpleString()}"
            )
    return sales


def check_input(sales: DataFrame) -> DataFrame:
    """The sales columns and at least one row, else an error."""
    if check_columns(sales).isEmpty():
        raise ValueError("the sales table is empty")
    return sales


#: Outputs that carry real names.
NAMED_OUTPUTS = ("inbox",)


def digest(df: DataFrame, *by: str) -> DataFrame:
    """Rows and a digest over all columns, per ``by``: the sum of 32 bits of each row's hash, in any order of rows."""
    columns = [F.array_join(c, "\n") if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).alias("digest"))


def write_parts(df: DataFrame, path: str, by: str) -> list[str]:
    """Write ``df`` split by ``by``; of a dataset that is there, only the parts that differ. Returns those written.

    One row for each part visits the driver, so ``by`` must have few values.
    """

    def parts(rows: DataFrame) -> dict:
        return {row[by]: (row["rows"], row["digest"]) for row in digest(rows.select(df.columns), by).collect()}

    new = parts(df)
    old = {}
    if has_rows(df.sparkSession, path):
        old = parts(df.sparkSession.read.schema(df.schema).parquet(path))
    changed = sorted(part for part, value in new.items() if old.get(part) != value)
    gone = old.keys() - new.keys()
    if gone or not old:
        df.write.mode("overwrite").partitionBy(by).parquet(path)
        return sorted(new)
    if changed:
        rows = df.where(F.col(by).isin(changed)).write.mode("overwrite").partitionBy(by)
        rows.option("partitionOverwriteMode", "dynamic").parquet(path)
    return changed


def write_outputs(outputs: dict[str, DataFrame], directory: str, named_directory: str) -> None:
    """One Parquet dataset per output; findings are split by risk type.

    Of the findings of an earlier run only the risk types that changed are written
    again. Outputs with real names go to a folder of their own, which can be kept
    under stricter access than the rest.
    """
    if named_directory.rstrip("/") == directory.rstrip("/"):
        raise ValueError("outputs with real names need a folder of their own")
    for name, df in outputs.items():
        folder = named_directory if name in NAMED_OUTPUTS else directory
        path = f"{folder.rstrip('/')}/{name}"
        if name == "findings":
            write_parts(df, path, "risk_type")
        else:
            df.write.mode("overwrite").parquet(path)


def save_by_customer(sales: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Sales that are loaded again and again, as a table bucketed and sorted by customer.

    Sums, windows and joins by customer then read their rows in place, without a
    shuffle. A bucket is one task, so a customer with a large part of all rows makes
    a large task; leave such sales in files.
    """
    sorted_by = ("customer_name", "transaction_date")
    writer = sales.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "customer_name").sortBy(*sorted_by).saveAsTable(table)
    return sales.sparkSession.table(table)
