import pytest
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.functions import fixed_values as fixed
from tidewatch.operators import inbox, playbook, summaries
from tidewatch.plans.risk_run import RiskRun


@pytest.fixture(scope="module")
def run(sample):
    return RiskRun(sample)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_inbox_has_names_and_no_tokens(run):
    cards = run.inbox.collect()
    assert len(cards) == 6
    for card in cards:
        texts = [card["evidence"], card["rationale"], card["body"], card["share_link"], *card["action_steps"]]
        assert not any("CUSTOMER_" in text for text in texts)
        assert card["customer_name"] in card["evidence"] and card["customer_name"] in card["body"]


def test_outputs_hold_tokens_only(run):
    names = [r["name"] for r in run.dictionary.collect()]
    for df in (run.findings, run.strategies, run.messages, run.cards, run.metrics):
        text = str(df.collect())
        assert not any(name in text for name in names)


def test_projected_cards_equal_joined_cards(run):
    joined = inbox.cards(run.findings, run.strategies, run.messages)
    assert sorted(map(str, joined.collect())) == sorted(map(str, run.cards.collect()))


def test_two_drafts_per_strategy_with_tone(run):
    assert rows(run.messages, "customer_id", "channel", "tone", "length_ok") == {
        (f"CUSTOMER_{n}", channel, tone, True)
        for n in (1, 2, 3, 5, 6, 7)
        for channel, tone in (
            ("EMAIL", "FORMAL"),
            ("WHATSAPP", "URGENT" if n == 3 else "FRIENDLY_PROFESSIONAL"),
        )
    }
    emails = run.messages.where("channel = 'EMAIL'").collect()
    assert all(r["subject"] for r in emails)
    assert all(f"[{r['customer_id']} yöneticisi]" in r["body"] for r in emails)
    assert rows(run.messages.where("channel = 'WHATSAPP'"), "subject") == {("",)}


def test_priority_and_routing(run):
    assert rows(run.strategies, "customer_id", "priority") == {
        ("CUSTOMER_1", "HIGH"), ("CUSTOMER_2", "HIGH"), ("CUSTOMER_3", "URGENT"), ("CUSTOMER_5", "HIGH"),
        ("CUSTOMER_6", "MEDIUM"), ("CUSTOMER_7", "LOW"),
    }
    low = run.findings.withColumn("severity", F.when(F.col("pos") == 1, "LOW").otherwise(F.col("severity")))
    assert rows(playbook.routed(low).where("queue = 'AUTO'"), "customer_id") == {("CUSTOMER_1",), ("CUSTOMER_7",)}


def test_first_of_each_side_wins(run):
    later = run.findings.withColumns({"pos": F.col("pos") + 100, "risk_type": F.lit("BOTH")})
    cards = inbox.cards(
        later.unionByName(run.findings), run.strategies.unionByName(run.strategies), run.messages
    )
    assert rows(cards, "customer_id", "pos", "risk_type") == rows(
        run.findings, "customer_id", "pos", "risk_type"
    )
    assert rows(inbox.customers_in_order(later.unionByName(run.findings)), "pos") == {(1,), (2,), (3,), (5,), (6,), (7,)}


def test_missing_strategy_and_message_show_defaults(run):
    none = run.strategies.limit(0)
    card = inbox.named_cards(inbox.cards(run.findings, none, run.messages.limit(0)), run.dictionary).first()
    assert card["strategy_title"] == fixed.NO_TITLE and card["rationale"] == fixed.NO_RATIONALE
    assert card["action_steps"] == [fixed.NO_STEP]
    assert card["body"] is None and card["share_link"] is None


def test_card_with_unknown_token_fails(run):
    stranger = run.cards.withColumn("customer_id", F.lit("CUSTOMER_77"))
    with pytest.raises(Exception, match="unknown token CUSTOMER_77"):
        inbox.named_cards(stranger.limit(1), run.dictionary).collect()


def test_most_urgent(run):
    top = inbox.most_urgent(run.cards, 2)
    assert [r["customer_id"] for r in top.collect()] == ["CUSTOMER_3", "CUSTOMER_5"]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_coverage(run):
    findings, strategies, messages = run.findings, run.strategies, run.messages
    assert inbox.coverage_gaps(findings, strategies, messages).count() == 0
    orphan = strategies.where("pos = 1").withColumn("customer_id", F.lit("CUSTOMER_50"))
    gaps = inbox.coverage_gaps(
        findings,
        strategies.where("pos != 2").unionByName(strategies.where("pos = 3")).unionByName(orphan),
        messages.where("NOT (customer_id = 'CUSTOMER_5' AND channel = 'EMAIL')"),
    )
    assert {r["customer_id"]: r["problems"] for r in gaps.collect()} == {
        "CUSTOMER_2": ["STRATEGY_MISSING", "MESSAGE_ORPHAN"],
        "CUSTOMER_3": ["STRATEGY_EXTRA", "EMAIL_MISSING", "WHATSAPP_MISSING"],
        "CUSTOMER_5": ["EMAIL_MISSING"],
        "CUSTOMER_50": ["STRATEGY_ORPHAN", "EMAIL_MISSING", "WHATSAPP_MISSING"],
    }


def test_checks_of_all_hand_offs_reach_errors(sample):
    spoiled = RiskRun(sample)
    first = spoiled.messages.withColumn("body", F.when(F.col("customer_id") == "CUSTOMER_1", "Fener Halat Ltd.").otherwise(F.col("body")))
    spoiled.messages = playbook.length_check(first.drop("length_ok")).where("NOT (customer_id = 'CUSTOMER_2' AND channel = 'EMAIL')")
    spoiled.findings = spoiled.findings.withColumn(
        "customer_id", F.when(F.col("pos") == 3, "CUSTOMER_90").otherwise(F.col("customer_id"))
    )
    assert {tuple(r) for r in spoiled.errors.collect()} == {
        ("coverage", "CUSTOMER_2", "EMAIL_MISSING"),
        ("coverage", "CUSTOMER_3", "STRATEGY_ORPHAN"),
        ("coverage", "CUSTOMER_90", "STRATEGY_MISSING"),
        ("tokens", "CUSTOMER_90", "UNKNOWN_TOKEN"),
        ("length", "CUSTOMER_1", "LENGTH_EMAIL"),
        ("length", "CUSTOMER_1", "LENGTH_WHATSAPP"),
        ("leaks", "tokens/CUSTOMER_1/EMAIL/body", "LEAKED_NAME"),
        ("leaks", "tokens/CUSTOMER_1/WHATSAPP/body", "LEAKED_NAME"),
    }
    assert spoiled.run_counts.where("metric = 'errors'").first()["value"] == 8


def test_summaries(run):
    assert run.analysis_summary.first()[0] == (
        "6 müşteri riskli bulundu: 3 kayıp riski, 2 marj baskısı, 1 her ikisi; 1 bulgu kritik düzeyde."
    )
    assert run.strategy_summary.first()[0] == "6 öneri hazırlandı; 1 tanesi acil öncelikli."
    assert {tuple(r) for r in run.run_counts.collect()} == {
        ("findings", 6), ("strategies", 6), ("messages", 12), ("errors", 0),
    }
    rollup = {(r["risk_type"], r["severity"]): r["findings"] for r in summaries.risk_rollup(run.findings).collect()}
    assert rollup[("ALL", "ALL")] == 6 and rollup[("CHURN_RISK", "ALL")] == 3


def test_load_counts(sample):
    counts = summaries.load_counts(sample.withColumnRenamed("customer_name", "customer_id"))
    assert tuple(counts.first()) == (25, 7)
    empty = summaries.load_counts(sample.limit(0).withColumnRenamed("customer_name", "customer_id"))
    assert tuple(empty.first()) == (0, 0)


def test_coverage_goes_by_finding(sample):
    """One finding with two strategies does not hide one with none."""
    run = RiskRun(sample, RiskConfig(grain=("category",)))
    findings, strategies, messages = run.findings, run.strategies, run.messages
    grain = ["category"]
    assert inbox.coverage_gaps(findings, strategies, messages, grain).count() == 0
    keys = [tuple(r) for r in findings.select("customer_id", "category").orderBy("customer_id", "category").collect()]
    customer = next(c for c, _ in keys if sum(k[0] == c for k in keys) > 1) if len({c for c, _ in keys}) < len(keys) else None
    if customer is None:
        # No customer has two findings in the sample: make a second one of a copy.
        copied = [df.withColumn("category", F.concat("category", F.lit("+"))).unionByName(df) for df in (findings, strategies, messages)]
        findings, strategies, messages = copied
        customer = keys[0][0]
    own = strategies.where(F.col("customer_id") == customer)
    one = own.select("category").first()[0]
    spoiled = strategies.where(F.col("customer_id") != customer)
    first = own.where(F.col("category") == one)
    gaps = inbox.coverage_gaps(findings, spoiled.unionByName(first).unionByName(first), messages, grain)
    found = {r["category"]: r["problems"] for r in gaps.collect()}
    assert found.pop(one) == ["STRATEGY_EXTRA", "EMAIL_MISSING", "WHATSAPP_MISSING"]
    assert found and all(problems == ["STRATEGY_MISSING", "MESSAGE_ORPHAN"] for problems in found.values())
