"""Pseudonyms: one token per customer name, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import check_prefix
from tidewatch.functions.expressions import is_blank
from tidewatch.operators.ranking import with_position
from tidewatch.sources.storage import store

# Reason written for a row whose name cannot be masked.
EMPTY_NAME = "MASK_EMPTY"
UNKNOWN_TOKEN = "UNKNOWN_TOKEN"


def split_by_name(df: DataFrame, name_col: str = "customer_name") -> tuple[DataFrame, DataFrame]:
    """M6: rows with a usable name, and the others with a reason."""
    require_text(df, name_col)
    blank = is_blank(F.col(name_col))
    return df.where(~blank), df.where(blank).withColumn("reason", F.lit(EMPTY_NAME))


def require_text(df: DataFrame, column: str) -> None:
    """An identifier that is not text is a mistake of the caller."""
    kind = df.schema[column].dataType.simpleString()
    if kind != "string":
        raise TypeError(f"{column} must be a string column, got {kind}")


def token_for(number, prefix: str):
    return F.concat(F.lit(f"{prefix}_"), number.cast("string"))


def first_seen(sales: DataFrame, name_col: str = "customer_name", order_key: str = "id") -> DataFrame:
    """Distinct usable names with their smallest order key.

    The minimum is taken before the shuffle, so a name with very many rows
    sends one row per task.
    """
    usable, _ = split_by_name(sales, name_col)
    return usable.groupBy(F.col(name_col).alias("name")).agg(F.min(order_key).alias("first_key"))


def build_dictionary(
    sales: DataFrame,
    name_col: str = "customer_name",
    order_key: str = "id",
    prefix: str = "CUSTOMER",
    previous: DataFrame | None = None,
) -> DataFrame:
    """M1, M2, M7, M9: columns ``name, token, token_no``.

    Numbers follow the first appearance by ``order_key``. With ``previous``
    known names keep their token and new ones continue the count; without it
    the count starts again at 1.
    """
    check_prefix(prefix)
    names = first_seen(sales, name_col, order_key)
    if previous is None:
        return number_names(names, prefix)
    return extend_dictionary(previous, names, prefix)


def number_names(names: DataFrame, prefix: str, start: int = 0) -> DataFrame:
    """Number ``name, first_key`` rows from ``start + 1`` on.

    They are stored first: ranges are found from a sample, which would run the
    aggregation before it once more.
    """
    ranked = with_position(store(names, "names"), ["first_key", "name"], "token_no")
    number = F.col("token_no") + F.lit(start).cast("bigint")
    return ranked.select("name", token_for(number, prefix).alias("token"), number.alias("token_no"))


def last_number(dictionary: DataFrame) -> int:
    return dictionary.agg(F.max("token_no").alias("last")).first()["last"] or 0


def added_names(previous: DataFrame, names: DataFrame, prefix: str, last: int | None = None) -> DataFrame:
    """M2: the names that ``previous`` lacks, numbered after ``last``, by
    default the last number of ``previous``."""
    if last is None:
        last = last_number(previous)
    unknown = names.join(previous.select("name"), "name", "left_anti")
    return number_names(unknown, prefix, last)


def extend_dictionary(previous: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """M2: ``previous`` plus the names it lacks."""
    known = previous.select("name", "token", "token_no")
    return known.unionByName(added_names(previous, names, prefix))


def export_map(dictionary: DataFrame) -> DataFrame:
    """M8: real name and token. Keep it in a restricted place."""
    return dictionary.select("name", "token")


def reset_dictionary(
    sales: DataFrame, path: str, name_col: str = "customer_name", order_key: str = "id", prefix: str = "CUSTOMER"
) -> DataFrame:
    """M9: replace the dictionary stored at ``path``; numbers start again at 1.

    Nothing of the old one is read, so its tokens do not resolve any more.
    """
    fresh = build_dictionary(sales, name_col, order_key, prefix)
    fresh.write.mode("overwrite").parquet(path)
    return sales.sparkSession.read.schema(fresh.schema).parquet(path)


def mask(
    df: DataFrame, dictionary: DataFrame, name_col: str = "customer_name", out: str = "customer_id"
) -> DataFrame:
    """M3: put the token in place of the name; every row stays.

    The join has no hint: Catalyst broadcasts the dictionary only if its
    measured size allows, else both sides shuffle and the skew handling of
    adaptive execution splits a customer with very many rows.
    """
    tokens = dictionary.select(F.col("name").alias(name_col), F.col("token").alias(out))
    return df.join(tokens, name_col, "left").drop(name_col)


def unmask(
    df: DataFrame,
    dictionary: DataFrame,
    token_col: str = "customer_id",
    out: str = "customer_name",
    strict: bool = True,
) -> DataFrame:
    """M4: add the real name. ``strict`` fails the job on an unknown token;
    otherwise the name is NULL and ``unknown_tokens`` lists the row."""
    names = dictionary.select(F.col("token").alias(token_col), F.col("name").alias(out))
    joined = df.join(names, token_col, "left")
    if not strict:
        return joined
    message = F.concat(F.lit("unknown token "), F.coalesce(F.col(token_col), F.lit("NULL")))
    return joined.withColumn(out, F.coalesce(F.col(out), F.raise_error(message)))


def unknown_tokens(df: DataFrame, dictionary: DataFrame, token_col: str = "customer_id") -> DataFrame:
    """M4, V3: rows whose token is not in the dictionary."""
    known = dictionary.select(F.col("token").alias(token_col))
    return df.join(known, token_col, "left_anti").withColumn("reason", F.lit(UNKNOWN_TOKEN))


def unmask_text(
    df: DataFrame,
    dictionary: DataFrame,
    key_cols: Sequence[str],
    text_cols: Sequence[str],
    array_cols: Sequence[str] = (),
    prefix: str = "CUSTOMER",
) -> DataFrame:
    """M5: replace every known token inside texts, and inside arrays of texts.

    ``key_cols`` identify a row. Tokens match as a whole, so the token number 1
    is not found inside number 10; replaced text is not searched again; unknown
    tokens stay. Only the tokens of a text travel to the dictionary join. The
    names come back as one map per row, and each text crosses one shuffle.
    """
    check_prefix(prefix)
    pattern = f"{prefix}_[0-9]+"
    keys = list(key_cols)

    def tokens_in(text):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    per_column = [F.coalesce(tokens_in(F.col(c)), F.array()) for c in text_cols]
    per_column += [
        F.coalesce(F.flatten(F.transform(c, lambda t: F.coalesce(tokens_in(t), F.array()))), F.array())
        for c in array_cols
    ]
    mentions = df.select(*keys, F.explode(F.array_distinct(F.concat(*per_column))).alias("token"))
    names = (
        mentions.join(dictionary.select("token", "name"), "token")
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_set(F.struct("token", "name"))).alias("_names"))
    )

    def restored(text):
        between = F.split(text, pattern, -1)
        found = F.array_append(tokens_in(text), "")
        pieces = F.zip_with(
            between,
            found,
            lambda plain, token: F.concat(
                plain, F.coalesce(F.try_element_at("_names", token), token)
            ),
        )
        return F.when(F.col("_names").isNull(), text).otherwise(F.array_join(pieces, ""))

    columns = {c: restored(F.col(c)) for c in text_cols}
    columns |= {c: F.transform(c, restored) for c in array_cols}
    return df.join(names, keys, "left").withColumns(columns).drop("_names")


def masked_sales(sales: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Token plus the six sales columns; no name, no record id."""
    usable, _ = split_by_name(sales)
    return mask(usable, dictionary).select(
        "customer_id",
        "transaction_date",
        "category",
        "quantity",
        "unit_sales_price",
        "unit_cost",
        "payment_term",
    )
