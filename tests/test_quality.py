from datetime import date

import pytest

from tests.helpers import sales_of
from tidewatch import schemas
from tidewatch.operators import quality
from tidewatch.plans.risk_run import RiskRun

GOOD = (date(2024, 1, 1), "Ada", "Kumaş", 5, 10.0, 4.0, "Net 30")


def broken(**changes):
    names = schemas.SALES_REQUIRED.fieldNames()
    return tuple(changes.get(name, value) for name, value in zip(names, GOOD))


CASES = [
    (broken(), []),
    (broken(transaction_date=None), ["NULL_TRANSACTION_DATE"]),
    (broken(quantity=None, payment_term=None), ["NULL_QUANTITY", "NULL_PAYMENT_TERM"]),
    (broken(customer_name=" "), ["MASK_EMPTY"]),
    (broken(customer_name="x" * 256), ["LONG_CUSTOMER_NAME"]),
    (broken(customer_name="x" * 255), []),
    (broken(category="x" * 101, unit_cost=None), ["NULL_UNIT_COST", "LONG_CATEGORY"]),
    (broken(unit_sales_price=0.0), ["ZERO_UNIT_SALES_PRICE"]),
    (broken(unit_sales_price=None), ["NULL_UNIT_SALES_PRICE"]),
    (broken(payment_term="x" * 51), ["LONG_PAYMENT_TERM"]),
    (broken(quantity=-3), []),
    (broken(unit_cost=float("nan")), ["NOT_FINITE_UNIT_COST"]),
    (broken(unit_sales_price=float("-inf"), unit_cost=float("inf")), ["NOT_FINITE_UNIT_SALES_PRICE", "NOT_FINITE_UNIT_COST"]),
]


def dirty(spark):
    loose = schemas.T.StructType(
        [schemas.T.StructField(f.name, f.dataType, True) for f in schemas.SALES.fields]
    )
    return spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(CASES)], loose)


def test_contract_splits_every_row_once(spark):
    valid, rejected = quality.enforce_contract(dirty(spark))
    reasons = {r["id"]: r["reasons"] for r in rejected.collect()}
    reasons |= {r["id"]: [] for r in valid.collect()}
    assert reasons == {i: expected for i, (_, expected) in enumerate(CASES)}


def test_bad_rows_reach_errors_and_nothing_else(spark):
    run = RiskRun(dirty(spark))
    assert run.run_counts.collect()[-1]["value"] == 13
    errors = {(r["key"], r["reason"]) for r in run.errors.collect()}
    assert errors == {(str(i), reason) for i, (_, reasons) in enumerate(CASES) for reason in reasons}
    assert {r["name"] for r in run.dictionary.collect()} == {"Ada", "x" * 255}


def judged(spark, schema, *raw):
    rows = spark.createDataFrame(list(enumerate(raw)), "key int, raw string")
    valid, rejected = quality.validate_json(rows, schema, keep=("key",))
    out = {r["key"]: tuple(r)[1:] for r in valid.collect()}
    return out | {r["key"]: r["reasons"] for r in rejected.collect()}


def test_findings_from_json(spark):
    base = '"customer_id":"CUSTOMER_1","risk_type":"BOTH","severity":"LOW","evidence":"e"'
    got = judged(
        spark,
        schemas.FINDING,
        "{%s,\"metric_value\":0.5}" % base,
        "{%s,\"metric_value\":\"0.5\",\"extra\":[1]}" % base,
        "{%s,\"metric_value\":7}" % base,
        "{%s}" % base,
        "{%s,\"metric_value\":\"many\"}" % base,
        "{%s,\"metric_value\":null}" % base,
        '{"customer_id":5,"risk_type":"NONE","severity":"LOW","evidence":null,"metric_value":1}',
        '{"customer_id":"CUS',
        "[]",
        "5",
        None,
        "",
    )
    fine = ("CUSTOMER_1", "BOTH", "LOW", "e")
    missing = [f"MISSING_{f}" for f in schemas.FINDING.fieldNames()]
    assert got == {
        0: (*fine, 0.5),
        1: (*fine, 0.5),
        2: (*fine, 7.0),
        3: ["MISSING_metric_value"],
        4: ["TYPE_metric_value"],
        5: ["TYPE_metric_value"],
        6: ["TYPE_customer_id", "VALUE_risk_type", "TYPE_evidence"],
        7: ["BROKEN_JSON"],
        8: missing,
        9: missing,
        10: ["BROKEN_JSON"],
        11: ["BROKEN_JSON"],
    }


def test_strategies_from_json(spark):
    def raw(steps):
        return (
            '{"customer_id":"CUSTOMER_1","risk_type":"BOTH","strategy_title":"t","rationale":"r",'
            f'"action_steps":{steps},"priority":"URGENT"}}'
        )

    got = judged(spark, schemas.STRATEGY, raw('["a","b"]'), raw("[]"), raw('"a"'), raw("[1]"))
    fine = ("CUSTOMER_1", "BOTH", "t", "r")
    assert got == {
        0: (*fine, ["a", "b"], "URGENT"),
        1: (*fine, [], "URGENT"),
        2: ["TYPE_action_steps"],
        3: ["TYPE_action_steps"],
    }


def test_messages_get_the_default_subject(spark):
    def raw(extra):
        return '{"customer_id":"CUSTOMER_1","channel":"EMAIL","body":"b","tone":"FORMAL"%s}' % extra

    got = judged(spark, schemas.MESSAGE, raw(""), raw(',"subject":"s"'), raw(',"subject":null'))
    assert got == {
        0: ("CUSTOMER_1", "EMAIL", "", "b", "FORMAL"),
        1: ("CUSTOMER_1", "EMAIL", "s", "b", "FORMAL"),
        2: ["TYPE_subject"],
    }


def test_reports_unwrap(spark):
    item = '{"customer_id":"CUSTOMER_%d","risk_type":"BOTH","severity":"LOW","evidence":"e","metric_value":1}'
    rows = spark.createDataFrame(
        [
            (1, '{"findings":[%s,%s,{"x":1}],"summary":"two"}' % (item % 1, item % 2)),
            (2, '{"findings":[],"summary":"none"}'),
            (3, '{"summary":"no list"}'),
            (4, "broken"),
            (5, '{"findings":"text","summary":"s"}'),
            (6, '{"findings":[%s]}' % (item % 6)),
            (7, '{"findings":null,"summary":7}'),
        ],
        "key int, raw string",
    )
    items, notes, broken_reports = quality.unwrap_reports(rows, "findings", "summary", keep=("key",))
    valid, rejected = quality.validate_objects(items, schemas.FINDING, keep=("key", "item_no"))
    assert {(r["key"], r["item_no"], r["customer_id"]) for r in valid.collect()} == {
        (1, 0, "CUSTOMER_1"), (1, 1, "CUSTOMER_2"),
    }
    assert [(r["key"], r["item_no"], len(r["reasons"])) for r in rejected.collect()] == [(1, 2, 5)]
    assert {r["key"]: r["summary"] for r in notes.collect()} == {1: "two", 2: "none", 3: "no list"}
    assert {r["key"]: r["reasons"] for r in broken_reports.collect()} == {
        4: ["BROKEN_JSON"],
        5: ["TYPE_findings"],
        6: ["MISSING_summary"],
        7: ["TYPE_findings", "TYPE_summary"],
    }


def test_null_items_are_no_steps(spark):
    record = '{"customer_id":"C","risk_type":"BOTH","strategy_title":"t","rationale":"r","action_steps":%s,"priority":"LOW"}'
    rows = spark.createDataFrame([(n, record % s) for n, s in enumerate(('["a",null]', "[null]", "[]"))], "key int, raw string")
    valid, rejected = quality.validate_json(rows, schemas.STRATEGY, keep=("key",))
    assert [r["key"] for r in valid.collect()] == [2]
    assert {r["key"]: r["reasons"] for r in rejected.collect()} == {0: ["TYPE_action_steps"], 1: ["TYPE_action_steps"]}


def test_accumulate_and_last_write(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "field string, value int")
    two = spark.createDataFrame([("a", 2)], "value_field string, value int").toDF("field", "value")
    both = quality.accumulate(("1", one), ("2", two))
    assert both.count() == 3
    last = quality.last_write(both, "field", "value", "step")
    assert {tuple(r) for r in last.collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("rows", [[], [("calm", 1, 10, 10, 5)]])
def test_no_findings_flow_through(spark, rows):
    run = RiskRun(sales_of(spark, rows))
    assert run.findings.count() == run.strategies.count() == run.messages.count() == run.inbox.count() == 0
    assert run.analysis_summary.first()[0] == "Riskli müşteri bulunmadı."
    assert run.strategy_summary.first()[0] == "No risks detected; no strategies required."
