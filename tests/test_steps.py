"""Steps that fail, and runs that go on."""

from pyspark.sql import functions as F

from tidewatch.plans.risk_run import RiskRun
from tidewatch.plans.steps import run_in_steps


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_failed_step_leaves_the_others_and_a_rerun_goes_on(spark, sample, tmp_path):
    def fails(strategies):
        return strategies.withColumn("body", F.raise_error(F.lit("no drafts today")))

    calls = []

    def counted(findings):
        from tidewatch.operators import playbook

        calls.append(1)
        return playbook.strategies(findings)

    first = run_in_steps(sample, str(tmp_path), changed={"messages": fails, "strategies": counted})
    whole = RiskRun(sample)
    assert rows_of(first["findings"]) == rows_of(whole.findings)
    assert rows_of(first["strategies"]) == rows_of(whole.strategies)
    assert first["messages"].count() == 0 and first["inbox"].count() == 6
    assert first["inbox"].where("body IS NOT NULL").count() == 0
    failed = [r for r in first["errors"].collect() if r["step"] != "coverage"]
    assert [(r["step"], "no drafts today" in r["reason"]) for r in failed] == [("messages", True)]
    assert {r["reason"] for r in first["errors"].where("step = 'coverage'").collect()} == {"EMAIL_MISSING", "WHATSAPP_MISSING"}

    again = run_in_steps(sample, str(tmp_path), changed={"strategies": counted})
    assert calls == [1]
    assert rows_of(again["messages"]) == rows_of(whole.messages)
    assert rows_of(again["inbox"].select(whole.inbox.columns)) == rows_of(whole.inbox)
    assert again["errors"].count() == 0


def test_failed_first_step_gives_empty_outputs(sample, tmp_path):
    def fails():
        raise ValueError("no table")

    outputs = run_in_steps(sample, str(tmp_path), changed={"dictionary_and_metrics": fails})
    assert {name: df.count() for name, df in outputs.items()} == {
        "dictionary_and_metrics": 0, "findings": 0, "strategies": 0, "messages": 0, "inbox": 0, "errors": 1,
    }
    assert outputs["errors"].first()["key"] == "ValueError"
