"""Contracts, validation and the quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.functions.expressions import is_blank
from tidewatch.operators.tokens import EMPTY_NAME

# Fields that may be absent, with the value they get then.
FIELD_DEFAULTS = {"subject": ""}


def contract_rules() -> dict[str, Column]:
    """Rules of the sales table: reason and the test that a broken row meets."""
    rules = {
        f"NULL_{field.name.upper()}": F.col(field.name).isNull()
        for field in schemas.SALES_REQUIRED.fields
        if field.name != "customer_name"
    }
    rules[EMPTY_NAME] = is_blank(F.col("customer_name"))
    for column, limit in schemas.TEXT_LIMITS.items():
        rules[f"LONG_{column.upper()}"] = F.coalesce(F.length(column) > limit, F.lit(False))
    rules["ZERO_UNIT_SALES_PRICE"] = F.coalesce(F.col("unit_sales_price") == 0, F.lit(False))
    for column in ("unit_sales_price", "unit_cost"):
        # NaN compares above every number, so one bound finds it as well.
        beyond = (F.col(column) >= float("inf")) | (F.col(column) <= float("-inf"))
        rules[f"NOT_FINITE_{column.upper()}"] = F.coalesce(beyond, F.lit(False))
    return rules


def breaks_contract() -> Column:
    """Whether a row breaks any rule; never NULL."""
    return reduce(Column.__or__, contract_rules().values())


def enforce_contract(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their ``reasons``.

    Valid rows pass plain comparisons, which run in generated code and reach
    the file scan where they can; reasons are only put together for the others.
    """
    rules, broken = contract_rules(), breaks_contract()
    reasons = F.array_compact(F.array(*[F.when(test, reason) for reason, test in rules.items()]))
    return sales.where(~broken), sales.where(broken).withColumn("reasons", reasons)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` plus computed columns, each evaluated once per row.

    A projection would be merged into whatever uses it, and a costly column
    repeated at each use. A generator over one element is not merged.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def _read_field(item: Column, field: T.StructField) -> dict[str, Column]:
    """JSON type of a field and its value in the declared type."""
    path = f"$.{field.name}"
    return {
        f"_{field.name}": F.schema_of_variant(F.try_variant_get(item, path, "variant")),
        field.name: F.try_variant_get(item, path, field.dataType.simpleString()),
    }


def _field_reason(field: T.StructField) -> Column:
    """Why a field read by ``_read_field`` is not usable; NULL if it is."""
    name, kind, value = field.name, F.col(f"_{field.name}"), F.col(field.name)
    if isinstance(field.dataType, T.DoubleType):
        usable = value.isNotNull()
    elif isinstance(field.dataType, T.ArrayType):
        empty = F.exists(value, lambda part: part.isNull())
        usable = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(empty, F.lit(True))
    else:
        usable = kind == "STRING"
    reason = F.when(~usable, f"TYPE_{name}")
    if name in schemas.ENUMS:
        reason = reason.when(~value.isin(*schemas.ENUMS[name]), f"VALUE_{name}")
    missing = F.lit(None) if name in FIELD_DEFAULTS else F.lit(f"MISSING_{name}")
    return F.when(kind.isNull(), missing).otherwise(reason)


def _field_value(field: T.StructField) -> Column:
    value = F.col(field.name)
    if field.name in FIELD_DEFAULTS:
        absent = F.col(f"_{field.name}").isNull()
        value = F.when(absent, FIELD_DEFAULTS[field.name]).otherwise(value)
    return value.alias(field.name)


def validate_objects(
    rows: DataFrame, schema: T.StructType, item_col: str = "item", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """V1: JSON objects as typed rows, and unusable ones with their ``reasons``.

    Numbers may come as text; nothing else changes its type. Missing fields
    with a default get it. The objects are VARIANT values, read once.
    """
    item = F.col(item_col)
    columns = {"_present": item.isNotNull()}
    for field in schema.fields:
        columns |= _read_field(item, field)
    fields = once(rows, list(keep), **columns)
    reasons = [_field_reason(field) for field in schema.fields]
    fits = reduce(Column.__and__, [reason.isNull() for reason in reasons], F.col("_present"))
    problems = F.when(~F.col("_present"), F.array(F.lit("BROKEN_JSON"))).otherwise(
        F.array_compact(F.array(*reasons))
    )
    valid = fields.where(fits).select(*keep, *[_field_value(field) for field in schema.fields])
    return valid, fields.where(~fits).select(*keep, problems.alias("reasons"))


def validate_json(
    rows: DataFrame, schema: T.StructType, raw_col: str = "raw", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """V1 over JSON text; text that is no JSON is rejected as ``BROKEN_JSON``."""
    parsed = once(rows, list(keep), item=F.try_parse_json(raw_col))
    return validate_objects(parsed, schema, "item", keep)


def unwrap_reports(
    rows: DataFrame, list_field: str, summary_field: str, raw_col: str = "raw", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V2: report wrappers as one row per list item, one summary each, and what was rejected.

    A missing list counts as empty. A wrapper that is no JSON, whose list is no
    list, or whose summary is missing or no text is rejected as a whole with its
    ``reasons``. Items stay VARIANT values for ``validate_objects``; ``item_no``
    is their place in the list.
    """
    report = once(rows, list(keep), report=F.try_parse_json(raw_col))

    def kind_of(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("report", f"$.{field}", "variant"))

    read = once(
        report,
        [*keep, "report"],
        summary=F.try_variant_get("report", f"$.{summary_field}", "string"),
        _list=kind_of(list_field),
        _summary=kind_of(summary_field),
    )
    reasons = [
        F.when(~F.col("_list").startswith("ARRAY"), f"TYPE_{list_field}"),
        F.when(F.col("_summary").isNull(), f"MISSING_{summary_field}").when(
            F.col("_summary") != "STRING", f"TYPE_{summary_field}"
        ),
    ]
    fits = F.col("report").isNotNull() & reduce(Column.__and__, [r.isNull() for r in reasons])
    problems = F.when(F.col("report").isNull(), F.array(F.lit("BROKEN_JSON"))).otherwise(
        F.array_compact(F.array(*reasons))
    )
    items = read.where(fits).select(
        *keep,
        F.posexplode(F.try_variant_get("report", f"$.{list_field}", "array<variant>")).alias(
            "item_no", "item"
        ),
    )
    return items, read.where(fits).select(*keep, "summary"), read.where(~fits).select(
        *keep, problems.alias("reasons")
    )


def accumulate(*steps: tuple[str, DataFrame]) -> DataFrame:
    """Outputs of several steps one after the other, marked by ``step``."""
    return reduce(
        DataFrame.unionByName, [df.withColumn("step", F.lit(name)) for name, df in steps]
    )


def last_write(updates: DataFrame, field_col: str, value_col: str, order_col: str) -> DataFrame:
    """Per field the value written last."""
    return updates.groupBy(field_col).agg(F.max_by(value_col, order_col).alias(value_col))


def as_errors(rejected: DataFrame, step: str, key: Column) -> DataFrame:
    """Rejected rows as error rows, one per reason.

    ``rejected`` has either an array ``reasons`` or a text ``reason``.
    """
    reason = F.explode("reasons") if "reasons" in rejected.columns else F.col("reason")
    return rejected.select(
        F.lit(step).alias("step"), key.cast("string").alias("key"), reason.alias("reason")
    )


def texts_of(rows: DataFrame, start: Column, *columns: str) -> DataFrame:
    """``key, text`` of some columns of each row, read once."""
    parts = [F.struct(F.concat(start, F.lit(name)).alias("key"), F.col(name).alias("text")) for name in columns]
    return rows.select(F.inline(F.array(*parts)))


def hand_on_texts(findings: DataFrame, strategies: DataFrame, messages: DataFrame) -> DataFrame:
    """``key, text`` of every text that a run hands on and that must hold tokens only."""
    own = F.concat(F.lit("tokens/"), "customer_id", F.lit("/"))
    listed = strategies.withColumn("action_steps", F.array_join("action_steps", "\n"))
    return (
        texts_of(findings, own, "evidence")
        .unionByName(texts_of(listed, own, "strategy_title", "rationale", "action_steps"))
        .unionByName(texts_of(messages, F.concat(own, "channel", F.lit("/")), "subject", "body"))
    )
