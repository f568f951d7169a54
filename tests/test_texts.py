"""Context blocks, lines, links and the leak audit, against plain Python."""

import random
import urllib.parse
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_text
from tidewatch.functions import expressions as X
from tidewatch.functions import fixed_values as fixed
from tidewatch.functions import wording
from tidewatch.operators import leak_audit, playbook, summaries

COLUMNS = "customer_id string, transaction_date date, category string, quantity int, unit_sales_price double, unit_cost double, payment_term string"


def line(row):
    price, cost = row[4], row[5]
    margin = (price - cost) / price * 100
    return (
        f"  {row[1]} | Category: {row[2]} | Qty: {row[3]} | Price: {price:.2f} TRY"
        f" | Cost: {cost:.2f} TRY | Margin: {margin:.1f}%"
    )


def whole_texts(blocks):
    parts = defaultdict(list)
    for row in blocks.orderBy("customer_id", "block").collect():
        parts[row["customer_id"]].append(row["text"])
    return {customer: "\n".join(texts) for customer, texts in parts.items()}


@pytest.mark.parametrize("block_lines", [3, 7, 1000])
def test_context_blocks(spark, block_lines):
    """One customer has most rows, one row has many copies."""
    random.seed(3)
    day = date(2024, 1, 1)
    rows = [
        (
            "CUSTOMER_1" if random.random() < 0.7 else f"CUSTOMER_{random.randrange(2, 13)}",
            day + timedelta(days=random.randrange(4)),
            random.choice(["A", "B"]),
            random.randrange(1, 9),
            random.choice([8.0, 10.0, 16.0]),
            random.choice([3.0, 6.5, 12.25]),
            "Net 30",
        )
        for _ in range(300)
    ]
    rows += [("CUSTOMER_2", day, "A", 1, 8.0, 3.0, "Net 30")] * 50
    blocks = summaries.context_blocks(
        spark.createDataFrame(rows, COLUMNS).repartition(5), block_lines
    ).cache()
    assert blocks.agg(F.max("pieces")).first()[0] <= block_lines
    expected = {}
    for customer in {r[0] for r in rows}:
        ordered = sorted(r[1:6] for r in rows if r[0] == customer)
        lines = [line((customer, *r)) for r in ordered]
        expected[customer] = "\n".join([f"\n=== {customer} ===", *lines])
    assert whole_texts(blocks) == expected


def test_sale_line(spark):
    row = ("CUSTOMER_1", date(2024, 1, 15), "Ham", 500, 85.0, 52.0, "Net 60")
    frame = spark.createDataFrame([row], COLUMNS)
    assert frame.select(X.sale_line()).first()[0] == (
        "  2024-01-15 | Category: Ham | Qty: 500 | Price: 85.00 TRY | Cost: 52.00 TRY | Margin: 38.8%"
    )


@pytest.mark.parametrize("places", [1, 2, 3])
def test_decimal_text_equals_format(spark, places):
    random.seed(5)
    values = [0.0, -0.04, 0.05, -0.05, 81.25, 2287.305, 1013.565, 0.125, 2.5e11 + 0.125, None]
    values += [round(random.uniform(-5000, 5000), places + 1) for _ in range(3000)]
    values += [random.randrange(-(10**6), 10**6) / 2 ** random.randrange(1, 12) for _ in range(3000)]
    values += [n / 10**places + 0.5 / 10**places for n in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [r[0] for r in frame.select(X.decimal_text(F.col("v"), places)).collect()]
    assert got == [None if v is None else f"{v:.{places}f}" for v in values]


def test_lines_of_findings_and_strategies(spark):
    finding = spark.createDataFrame(
        [("CUSTOMER_1", "BOTH", "CRITICAL", "x", 0.5, 1)],
        "customer_id string, risk_type string, severity string, evidence string, metric_value double, pos long",
    )
    assert [r["line"] for r in summaries.finding_lines(finding).collect()] == [
        "- CUSTOMER_1 | BOTH | Severity: CRITICAL | Metric: 0.500 | Evidence: x"
    ]
    strategy = spark.createDataFrame(
        [("CUSTOMER_1", "BOTH", "t", "r", ["a", "b"], "URGENT")],
        "customer_id string, risk_type string, strategy_title string, rationale string, action_steps array<string>, priority string",
    )
    assert summaries.strategy_blocks(strategy).first()["line"] == (
        "Customer: CUSTOMER_1\nRisk: BOTH | Priority: URGENT\nStrategy: t\nRationale: r\n"
        "Action Steps:\n    1. a\n    2. b"
    )
    assert summaries.finding_lines(finding.limit(0)).collect()[0]["line"] == fixed.NO_FINDINGS_LINE
    assert summaries.strategy_blocks(strategy.limit(0)).collect()[0]["line"] == fixed.NO_STRATEGIES_LINE


@pytest.mark.parametrize("text", ["a b&c/d?=*~.-_()", "Şirket %10 + ç\n\t🙂", "", "~*+ %2F"])
def test_share_link_equals_quote(spark, text):
    frame = spark.createDataFrame([(text,)], "body string")
    assert frame.select(X.share_link(F.col("body"))).first()[0] == fixed.SHARE_PREFIX + urllib.parse.quote(text)


@pytest.mark.parametrize("text", ["", "  ", "one", " a  b\nc\td ", "x y"])
def test_word_count(spark, text):
    frame = spark.createDataFrame([(text,)], "body string")
    assert frame.select(X.word_count(F.col("body"))).first()[0] == len(text.split())


def test_labels_fall_back(spark):
    frame = spark.createDataFrame([("HIGH",), ("ODD",)], "s string")
    tags = [r[0] for r in frame.select(X.severity_tag(F.col("s"))).collect()]
    assert tags == ["[🟠 YÜKSEK Risk]", "[⚪ ODD Risk]"]


@pytest.mark.parametrize(
    "risk, value, texts",
    [
        ("CHURN_RISK", 42.5, ("Sipariş Düşüşü", "%42.5", "-%42.5")),
        ("MARGIN_RISK", 0.081, ("Marj Baskısı", "%8.1", "-Kritik")),
        ("MARGIN_RISK", 12.0, ("Marj Baskısı", "12.0", "-Kritik")),
        ("BOTH", 47.49, ("Risk Skoru", "47.5", "-Dikkat")),
    ],
)
def test_metric_texts(spark, risk, value, texts):
    frame = spark.createDataFrame([(risk, value)], "r string, v double")
    r, v = F.col("r"), F.col("v")
    row = frame.select(X.metric_label(r), X.metric_text(r, v), X.metric_note(r, v)).first()
    assert tuple(row) == texts


def test_wording_contract():
    for channel, bodies in (("EMAIL", wording.EMAIL_BODIES), ("WHATSAPP", wording.CHAT_BODIES)):
        low, high = wording.WORD_LIMITS[channel]
        assert all(low <= len(body.split()) <= high for body in bodies.values())
    for play in wording.PLAYBOOK.values():
        assert 3 <= len(play["steps"]) <= 5 and len(play["title"].split()) <= 10


def test_length_check_flags(spark):
    rows = [("EMAIL", "a " * 149), ("EMAIL", "a " * 150), ("WHATSAPP", "a " * 100), ("WHATSAPP", "a " * 101)]
    checked = playbook.length_check(spark.createDataFrame(rows, "channel string, body string"))
    assert [r["length_ok"] for r in checked.collect()] == [False, True, True, False]


NAMES = ["Ada", "Ada Tekstil", "Çam Ltd", "Çam Ltd.", "日本", "🙂 Emo", "a.b*c", "Customer#000000001", "Customer#000000011"]


@pytest.mark.parametrize("names", [NAMES, NAMES[-2:], NAMES[:1]])
def test_leaks_equal_brute_force(spark, names):
    random.seed(11)
    pieces = NAMES + ["CUSTOMER_1", "Customer#0000000012", "çam ltd", "x", " ", "\n", "🙂", "A", "Ad", "日", "\ud83d".encode("utf-8", "replace").decode()]
    texts = [(str(i), "".join(random.choices(pieces, k=random.randrange(0, 12)))) for i in range(200)]
    texts += [("null", None), ("long", "x" * 5000 + "Ada" + "y" * 5000 + NAMES[-1])]
    dictionary = spark.createDataFrame([(n, "T") for n in names], "name string, token string")
    found = leak_audit.leaks(spark.createDataFrame(texts, "key string, text string"), dictionary, ["key"])
    expected = {(key, name) for key, text in texts if text for name in names if name in text}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_short_and_long_names_in_a_long_text(spark):
    """A one-letter name does not widen the search for long ones."""
    names = ["Q", "\\E[x]", *[f"N{n:03d}" + "z" * (n - 4) for n in range(100, 256)]]
    dictionary = spark.createDataFrame([(n, f"T{i}", i) for i, n in enumerate(names)], "name string, token string, token_no bigint")
    filler = "lorem ipsum dolor sit amet " * 4000
    texts = spark.createDataFrame([(0, filler), (1, filler + names[60] + filler), (2, "a\\E[x]b" + filler + "Q")], "key int, text string")
    found = leak_audit.leaks(texts, dictionary, ["key"]).collect()
    assert {(r["key"], r["name"]) for r in found} == {(1, names[60]), (2, "Q"), (2, "\\E[x]")}


def test_leak_audit_has_no_cross_join(spark):
    dictionary = spark.createDataFrame([("Ada", "T")], "name string, token string")
    texts = spark.createDataFrame([("1", "Ada")], "key string, text string")
    plan = plan_text(leak_audit.leaks(texts, dictionary, ["key"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = leak_audit.leaks(texts, dictionary.limit(0), ["key"])
    assert empty.columns == ["key", "name"] and empty.count() == 0
