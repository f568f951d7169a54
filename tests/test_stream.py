import numpy as np
import pyarrow as pa
import pytest
from helpers import plan_text
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.config import RiskConfig
from tidewatch.operators import periods, tokens
from tidewatch.plans.risk_run import RiskRun
from tidewatch.streaming.ids import _SPAN, count_once, packed, unpacked
from tidewatch.streaming.monitor import (
    _CHANGED,
    _LISTS,
    _SUMS,
    RiskMonitor,
    _bundles,
    _customers_of,
    _merged,
    latest,
    sales_stream,
    use_disk_state,
)

COLUMNS = ("customer_name", "risk_type", "severity", "metric_value")
TEXTS = ("customer_name", "evidence", "strategy_title", "rationale", "action_steps", "body", "share_link", "queue")


def rows_of(df, columns):
    return {tuple(map(str, row)) for row in df.select(*columns).collect()}


def expected(sample, config=RiskConfig()):
    run = RiskRun(sample, config)
    return rows_of(tokens.unmask(run.findings, run.dictionary), COLUMNS)


def current(monitor):
    return rows_of(tokens.unmask(monitor.findings(), monitor.dictionary()), COLUMNS)


def arrive(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(str(folder))


def run(monitor, folder):
    stream = count_once(sales_stream(monitor.spark, str(folder), files_per_batch=1))
    monitor.start(stream).awaitTermination()


@pytest.fixture(autouse=True)
def disk_state(spark):
    """State on disk, in few partitions, as each has a process of its own."""
    use_disk_state(spark)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_late_files_and_copies_equal_the_batch_result(spark, sample, tmp_path):
    """Newest quarter first; every file repeats rows of the newest quarter."""
    quarter = F.quarter("transaction_date")
    newest = sample.where(quarter == 4)
    for number in (4, 2, 1, 3):
        arrive(sample.where(quarter == number).unionByName(newest).unionByName(newest), tmp_path / "in")
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    run(monitor, tmp_path / "in")
    assert current(monitor) == expected(sample)
    first_ids = {r[0]: f"CUSTOMER_{r[1]}" for r in newest.groupBy("customer_name").agg(F.min("id")).collect()}
    held = {r["name"]: r["token"] for r in monitor.dictionary().collect()}
    assert len(held) == 7 and held.items() >= first_ids.items()

    # Files that come later go on from the checkpoint and keep all tokens.
    more = sample.where(quarter == 4).withColumns(
        {"id": F.col("id") + 100, "transaction_date": F.add_months("transaction_date", 3), "quantity": F.lit(1)}
    )
    arrive(more, tmp_path / "in")
    again = RiskMonitor(spark, str(tmp_path / "state"))
    run(again, tmp_path / "in")
    assert held == {r["name"]: r["token"] for r in again.dictionary().collect()}
    assert current(again) == expected(sample.unionByName(more))


def test_inbox_follows_each_batch_and_withdraws(spark, sample, tmp_path):
    """After each of three batches the changes add up to the batch inbox; one customer recovers."""
    parts = [
        sample.where("id <= 9 OR id IN (15, 16, 17, 18)"),
        sample.where("id > 9 AND id NOT IN (15, 16, 17, 18)"),
        sample.where("id = 18").withColumns({"id": F.lit(99).cast("bigint"), "quantity": F.lit(300)}),
    ]
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    so_far, before = sample.limit(0), set()
    for part in parts:
        so_far = so_far.unionByName(part)
        arrive(part, tmp_path / "in")
        run(monitor, tmp_path / "in")
        wanted = rows_of(RiskRun(so_far).inbox, TEXTS)
        feed = latest(monitor.changes())
        assert rows_of(feed.where("holds"), TEXTS) == wanted == rows_of(monitor.inbox(), TEXTS)
        withdrawn = {r[0] for r in feed.where("NOT holds").select("customer_name").collect()}
        assert withdrawn.isdisjoint({row[0] for row in wanted})
        gone = {row[0] for row in before} - {row[0] for row in wanted}
        assert gone <= withdrawn
        before = wanted
    assert gone
    assert feed.where("NOT holds AND (body IS NOT NULL OR risk_type IS NOT NULL)").count() == 0


def test_customers_who_stop_are_seen_without_a_row(spark, sample, tmp_path):
    """One customer orders on for a year; the others fall silent and come up month by month."""
    config = RiskConfig(period="month", fill_empty_periods=True)
    monitor = RiskMonitor(spark, str(tmp_path / "state"), config, buckets=3)
    arrive(sample, tmp_path / "in")
    run(monitor, tmp_path / "in")
    assert current(monitor) == expected(sample, config)
    loyal = sample.where("id = 18")
    name = loyal.first()["customer_name"]
    newest = sample.agg(F.max("transaction_date")).first()[0]
    so_far = sample
    for months in (2, 5):
        more = loyal.withColumns(
            {"id": F.lit(100 + months).cast("bigint"), "transaction_date": F.add_months(F.lit(newest), months)}
        )
        so_far = so_far.unionByName(more)
        arrive(more, tmp_path / "in")
        run(monitor, tmp_path / "in")
        assert current(monitor) == expected(so_far, config)
        feed = latest(monitor.changes())
        assert rows_of(feed.where("holds"), COLUMNS) == expected(so_far, config)
        others = monitor.changes().where(F.col("customer_name") != name)
        last = monitor.changes().agg(F.max("batch_id")).first()[0]
        assert others.where(F.col("batch_id") == last).select("customer_name").distinct().count() == 6
    # A late row of a silent customer still counts in its own past month.
    late = sample.where("id = 1").withColumns({"id": F.lit(900).cast("bigint"), "quantity": F.lit(5000)})
    arrive(late, tmp_path / "in")
    run(monitor, tmp_path / "in")
    assert current(monitor) == expected(so_far.unionByName(late), config)
    assert rows_of(latest(monitor.changes()).where("holds"), COLUMNS) == current(monitor)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    rows = spark.sql(
        "SELECT 'a' AS customer_name, 3L AS first_key, 24288 AS newest, array(24288) AS period, array(5L) AS quantity,"
        " array(50D) AS revenue, array(49D) AS cost_total"
    )
    for _ in range(2):
        monitor.absorb(rows, 0)
    assert [tuple(r) for r in monitor.changes().select("customer_id", "customer_name", "holds").collect()] == [
        ("CUSTOMER_3", "a", True)
    ]


def test_rejected_rows(spark, sample, tmp_path):
    bad = sample.where("id = 1").withColumns({"id": F.lit(999).cast("bigint"), "unit_sales_price": F.lit(0.0)})
    arrive(sample.unionByName(bad).unionByName(bad), tmp_path / "in")
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    run(monitor, tmp_path / "in")
    monitor.start_errors(sales_stream(spark, str(tmp_path / "in"))).awaitTermination()
    assert current(monitor) == expected(sample)
    assert [tuple(r) for r in monitor.errors().collect()] == [("load", "999", "ZERO_UNIT_SALES_PRICE")]


def test_names_with_signs_of_patterns(spark, sample, tmp_path):
    odd = sample.where("id IN (15, 16, 17, 18)").withColumn("customer_name", F.lit(r"A\1 $2 & Co."))
    arrive(odd, tmp_path / "in")
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    run(monitor, tmp_path / "in")
    assert rows_of(monitor.inbox(), TEXTS) == rows_of(RiskRun(odd).inbox, TEXTS) != set()


def test_findings_are_read_from_the_state_in_place(spark, sample, tmp_path):
    arrive(sample, tmp_path / "in")
    monitor = RiskMonitor(spark, str(tmp_path / "state"))
    run(monitor, tmp_path / "in")
    assert not any(word in plan_text(monitor.findings()) for word in ("Exchange", "Window", "Sort"))
    totals = monitor.totals().groupBy("customer_name").agg(F.sum("quantity"))
    assert rows_of(totals, totals.columns) == rows_of(sample.groupBy("customer_name").agg(F.sum("quantity")), totals.columns)


def test_restart_with_other_settings_is_refused(spark, tmp_path):
    path = str(tmp_path / "state")
    for _ in range(2):
        RiskMonitor(spark, path)
    for other in (RiskConfig(period="month"), RiskConfig(prefix="CLIENT"), RiskConfig(fill_empty_periods=True)):
        with pytest.raises(ValueError, match="was made with buckets=1024, fill_empty_periods=False, period=quarter"):
            RiskMonitor(spark, path, other)
    with pytest.raises(ValueError):
        RiskMonitor(spark, str(tmp_path / "grain"), RiskConfig(grain=("category",)))


@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from("abcdé"), st.integers(-3, 9), st.integers(-5, 50), st.integers(1, 99)), min_size=1),
        max_size=4,
    )
)
def test_bundles_add_up(batches):
    """Whole batches in one message equal sums row by row; tokens are of the first batch of a customer."""
    held = _customers_of(pa.array([], pa.string()), [], [], [0], [[] for _ in _LISTS])
    sums, firsts = {}, {}
    for batch in batches:
        names = {row[0] for row in batch} - set(firsts)
        firsts |= {name: min(row[3] for row in batch if row[0] == name) for name in names}
        for name, period, quantity, _ in batch:
            sums[name, period] = sums.get((name, period), 0) + quantity
        columns = list(zip(*[(n, p, q, q / 2, q / 4, key) for n, p, q, key in batch]))
        rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)
        bucket = pa.array([ord(row[0]) % 2 for row in batch], pa.int32())
        for _, message in _bundles(rows.append_column("bucket", bucket)):
            new = pa.ipc.read_record_batch(pa.py_buffer(message), _SUMS)
            held, touched = _merged(held, new)
            shown = held.filter(pa.array(touched)).column("customer_name").to_pylist()
            assert set(shown) == set(new.column("customer_name").to_pylist())
    rows = held.to_pylist()
    assert {row["customer_name"]: row["first_key"] for row in rows} == firsts and len(rows) == len(firsts)
    assert all(row["period"] == sorted(set(row["period"])) for row in rows)
    assert sums == {(r["customer_name"], p): q for r in rows for p, q in zip(r["period"], r["quantity"])}
    assert all(r["revenue"] == [q / 2 for q in r["quantity"]] and r["cost_total"] == [q / 4 for q in r["quantity"]] for r in rows)


@pytest.mark.parametrize("period, filled", [("month", True), ("quarter", True), ("month", False)])
def test_gaps_are_judged_without_rows_of_their_own(spark, tmp_path, period, filled):
    """Random customers with gaps, empty sums and returns: as the windows of the batch run, but nothing moves."""
    random, step, rows = np.random.default_rng(7), periods.PERIOD_MONTHS[period], []
    for number in range(400):
        size = int(random.integers(1, 7))
        places = sorted(random.choice(9, size, replace=False).tolist())
        quantity = [int(q) for q in random.choice([0, 0, 5, 8, 10, 40, -6], size)]
        money = [[float(x) for x in random.integers(1, 500, size)] for _ in range(2)]
        newest = places[-1] + int(random.integers(0, 5))
        months = [24000 + step * place for place in (*places, newest)]
        rows.append((f"c{number}", number, months[-1], months[:-1], quantity, *money))
    customers = spark.createDataFrame(rows, _CHANGED)
    monitor = RiskMonitor(spark, str(tmp_path), RiskConfig(period=period, fill_empty_periods=filled))
    verdicts = monitor._verdicts(customers)
    assert not any(word in plan_text(verdicts) for word in ("Exchange", "Window", "Generate"))

    month = F.make_date(F.lit(2000) + F.floor((F.col("period") - 24000) / 12).cast("int"), F.pmod("period", F.lit(12)) + 1, F.lit(1))
    newest = F.make_date(F.lit(2000) + F.floor((F.col("newest") - 24000) / 12).cast("int"), F.pmod("newest", F.lit(12)) + 1, F.lit(1))
    lists = F.inline(F.arrays_zip("period", "quantity", "revenue", "cost_total"))
    totals = customers.select("customer_name", newest.alias("newest"), lists).withColumn("period", month)
    if filled:
        totals = periods.fill_periods(totals, ["customer_name"], period, F.col("newest"))
    wanted = periods.customer_metrics(periods.period_trends(totals, ["customer_name"]), ["customer_name"])
    columns = ("customer_name", "periods", "max_single_drop", "last_drop", "two_period_drop", "current_margin", "growth_gap")
    assert rows_of(monitor._graded(customers), columns) == rows_of(wanted, columns)


# --- records counted once -------------------------------------------------------------


@given(st.sets(st.integers(0, _SPAN - 1)))
def test_spans_round_trip_in_little_space(places):
    bits = bytearray(_SPAN // 8)
    for place in places:
        bits[place >> 3] |= 1 << (place & 7)
    held = packed(bits)
    assert unpacked(held) == bits and len(held) <= min(2 * len(places), _SPAN // 8)


def once(spark, folder, base, key="id", files=None):
    reader = spark.readStream.schema(spark.read.parquet(str(folder)).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = (
        count_once(reader.parquet(str(folder)), key)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out")
    )
    query.awaitTermination()
    return query


def test_hot_key_is_thinned_before_it_is_moved(spark, tmp_path):
    """A third of the rows are copies of one key; ids lie far apart, below zero, or are missing."""
    number = F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") - 1500) * 10**12)
    rows = spark.range(3000).select(F.when(F.col("id") != 100, number).cast("bigint").alias("id"), F.lit("x").alias("v"))
    rows.unionByName(rows.where("id IS NULL")).repartition(4).write.parquet(str(tmp_path / "in"))
    query = once(spark, tmp_path / "in", tmp_path)
    kept = spark.read.parquet(str(tmp_path / "out"))
    wanted = {r[0] for r in rows.select("id").distinct().collect()}
    assert kept.count() == len(wanted) and {r["id"] for r in kept.collect()} == wanted
    operators = query.recentProgress[0]["stateOperators"]
    assert len(operators) == 1
    moved = query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"]
    assert moved <= len(wanted)


def test_one_small_state_over_many_batches(spark, tmp_path):
    """Dense ids, each file with copies of all before: one state, a row for 4,096 ids; late ids count."""
    for number in (3, 0, 1, 2):
        rows = spark.range(2000 * number, 2000 * number + 2000)
        rows = rows.unionByName(spark.range(6000, 6500)).withColumn("v", F.lit(number))
        arrive(rows, tmp_path / "in")
    query = once(spark, tmp_path / "in", tmp_path, files=1)
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == kept.select("id").distinct().count() == 8000
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert all(len(p["stateOperators"]) == 1 for p in query.recentProgress) and max(sizes) == 2


def test_keys_of_text(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("id"))
    arrive(rows, tmp_path / "in")
    once(spark, tmp_path / "in", tmp_path)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("0123456")
