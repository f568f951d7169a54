import pytest
from pyspark.sql import functions as F

from tests.helpers import sales_of
from tidewatch.config import RiskConfig
from tidewatch.operators import periods, risk
from tidewatch.plans.risk_run import RiskRun, named_metrics
from tidewatch.sources.sample import EXPECTED

# Metrics of the labelled sample, three decimals: largest drop, last drop,
# two-period drop, first margin, current margin, cost growth, price growth, gap.
SAMPLE_METRICS = {
    "Fener Halat Ltd.": (53.171, 45.833, 74.634, 0.329, 0.326, 2.909, 2.439, 0.47),
    "Kestane Mobilya A.Ş.": (5.714, 5.714, -3.125, 0.344, 0.073, 44.643, 2.344, 42.299),
    "İncir Gıda Ltd.": (31.405, 22.892, 47.107, 0.365, 0.087, 55.738, 8.333, 47.404),
    "Söğüt Optik A.Ş.": (2.778, 2.778, -6.061, 0.376, 0.377, 1.992, 2.239, -0.247),
    "Martı Seramik Ltd.": (74.942, 74.942, 74.588, 0.348, 0.35, 2.791, 3.03, -0.24),
    "Zeytin Yapı A.Ş.": (1.099, 1.099, -2.273, 0.175, 0.138, 7.071, 2.5, 4.571),
    "Pelit Kırtasiye Ltd.": (18.75, 17.308, 32.812, 0.346, 0.34, 2.941, 1.923, 1.018),
}


def classes(sales, config=RiskConfig()):
    found = risk.classify(named_metrics(sales, config, "id"), config)
    return {r["customer_name"]: r["risk_type"] for r in found.collect()}


def test_labelled_sample(sample):
    assert classes(sample) == EXPECTED


def test_sample_metrics(sample):
    rows = named_metrics(sample, RiskConfig(), "id").collect()
    got = {
        r["customer_name"]: tuple(
            round(r[c], 3)
            for c in (
                "max_single_drop",
                "last_drop",
                "two_period_drop",
                "first_margin",
                "current_margin",
                "cost_growth_pct",
                "price_growth_pct",
                "growth_gap",
            )
        )
        for r in rows
    }
    assert got == SAMPLE_METRICS


def test_severity_metric_and_evidence(sample):
    rows = {r["customer_id"]: r for r in RiskRun(sample).findings.collect()}
    assert {k: r["severity"] for k, r in rows.items()} == {
        "CUSTOMER_1": "HIGH",
        "CUSTOMER_2": "HIGH",
        "CUSTOMER_3": "CRITICAL",
        "CUSTOMER_5": "HIGH",
        "CUSTOMER_6": "MEDIUM",
        "CUSTOMER_7": "LOW",
    }
    assert rows["CUSTOMER_1"]["metric_value"] == 74.634146
    assert rows["CUSTOMER_2"]["metric_value"] == 0.072519
    assert rows["CUSTOMER_3"]["metric_value"] == 53.453638
    assert rows["CUSTOMER_2"]["evidence"].startswith("CUSTOMER_2: güncel brüt marj (%) 7.3;")


@pytest.mark.parametrize("factor", [0.01, 3.0])
def test_currency_changes_nothing(sample, factor):
    scaled = sample.withColumns(
        {c: F.col(c) * factor for c in ("unit_sales_price", "unit_cost")}
    )
    assert classes(scaled) == EXPECTED


def test_thresholds_are_inclusive(spark):
    rows = [
        ("two", 1, 100, 10, 5), ("two", 4, 90, 10, 5), ("two", 7, 70, 10, 5),
        ("single", 1, 100, 10, 5), ("single", 4, 50, 10, 5),
        ("near", 1, 1000, 10, 5), ("near", 4, 900, 10, 5), ("near", 7, 701, 10, 5),
        ("margin", 1, 10, 100, 86), ("level", 1, 10, 100, 85),
        ("gap", 1, 10, 100, 50), ("gap", 4, 10, 100, 55), ("slow", 1, 10, 100, 50), ("slow", 4, 10, 100, 54.9),
    ]
    assert classes(sales_of(spark, rows)) == {
        "two": "CHURN_RISK", "single": "CHURN_RISK", "near": None, "margin": "MARGIN_RISK",
        "level": None, "gap": "MARGIN_RISK", "slow": None,
    }


def test_single_period_has_no_churn_and_keeps_the_margin_rule(spark):
    rows = [("one", 1, 100, 10, 9.9), ("fine", 2, 5, 10, 1)]
    assert classes(sales_of(spark, rows)) == {"one": "MARGIN_RISK", "fine": None}


def test_drop_scope(spark):
    rows = [("old drop", 1, 100, 10, 5), ("old drop", 4, 40, 10, 5), ("old drop", 7, 100, 10, 5), ("old drop", 10, 100, 10, 5)]
    sales = sales_of(spark, rows)
    assert classes(sales) == {"old drop": "CHURN_RISK"}
    assert classes(sales, RiskConfig(drop_scope="latest")) == {"old drop": None}


def test_month_periods(spark):
    sales = sales_of(spark, [("m", 1, 100, 10, 5), ("m", 2, 40, 10, 5), ("m", 3, 400, 10, 5)])
    assert classes(sales) == {"m": None}
    assert classes(sales, RiskConfig(period="month")) == {"m": "CHURN_RISK"}


def test_empty_periods_reveal_a_customer_who_stopped(spark):
    rows = [("gone", 1, 100, 10, 5), ("gone", 4, 100, 10, 5), ("stays", 1, 10, 10, 5), ("stays", 10, 10, 10, 5)]
    sales = sales_of(spark, rows)
    assert classes(sales) == {"gone": None, "stays": None}
    filled = RiskConfig(fill_empty_periods=True)
    assert classes(sales, filled) == {"gone": "CHURN_RISK", "stays": "CHURN_RISK"}
    totals = periods.period_totals(sales, ["customer_name"])
    spine = periods.fill_periods(totals, ["customer_name"]).collect()
    got = {(r["customer_name"], str(r["period"])): r["quantity"] for r in spine}
    assert got == {
        ("gone", "2024-01-01"): 100, ("gone", "2024-04-01"): 100, ("gone", "2024-07-01"): 0, ("gone", "2024-10-01"): 0,
        ("stays", "2024-01-01"): 10, ("stays", "2024-04-01"): 0, ("stays", "2024-07-01"): 0, ("stays", "2024-10-01"): 10,
    }


def test_category_grain_gives_one_card_per_customer(spark):
    sales = sales_of(spark, [("c", 1, 100, 10, 5), ("c", 4, 10, 10, 5)])
    both = sales.unionByName(
        sales.withColumns({"category": F.lit("Taşıma"), "unit_cost": F.lit(9.9)})
    )
    run = RiskRun(both, RiskConfig(grain=("category",)))
    assert {(r["category"], r["risk_type"]) for r in run.findings.collect()} == {
        ("Kumaş", "CHURN_RISK"), ("Taşıma", "BOTH"),
    }
    assert run.inbox.count() == 1


def test_zero_quantity_base_is_no_drop(spark):
    assert classes(sales_of(spark, [("z", 1, 0, 10, 5), ("z", 4, 10, 10, 5), ("z", 7, 9, 10, 5)])) == {"z": None}


def test_margin_and_velocity(spark):
    sales = sales_of(spark, [("a", 1, 100, 10, 5), ("a", 2, 100, 10, 8), ("a", 4, 150, 10, 5), ("b", 1, 1, 10, 5)])
    got = {r["customer_name"]: (r[1], r[2]) for r in periods.margin_and_velocity(sales, key="customer_name").collect()}
    assert got == {"a": (0.4, -25.0), "b": (0.5, None)}


def test_merged_totals_equal_whole_totals(sample):
    keys = ["customer_name"]
    whole = periods.period_totals(sample, keys)
    parts = periods.period_totals(sample.where("id % 2 = 0"), keys, first_key="id").unionByName(
        periods.period_totals(sample.where("id % 2 = 1"), keys, first_key="id")
    )
    merged = periods.merge_totals(parts, keys).drop("first_key")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_config_rejects_unknown_options():
    for wrong in ({"period": "week"}, {"drop_scope": "none"}, {"prefix": "c"}):
        with pytest.raises(ValueError):
            RiskConfig(**wrong)


def test_previous_dictionary_is_continued(sample):
    first = RiskRun(sample.where("id > 18"))
    second = RiskRun(sample, previous=first.dictionary)
    old = {r["name"]: r["token"] for r in first.dictionary.collect()}
    new = {r["name"]: r["token"] for r in second.dictionary.collect()}
    assert len(old) == 2 and len(new) == 7 and old.items() <= new.items()
    assert second.inbox.count() == 6
