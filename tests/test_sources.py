import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_text
from tidewatch import schemas
from tidewatch.plans.risk_run import RiskRun, run_risk_analysis
from tidewatch.sources import raw_files, sales_table, storage


def test_raw_files(spark, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text(
        ",".join(schemas.RAW_HEADERS)
        + "\n2024-01-05,Ada Gıda,Tahıl,150,12.5,8.0,Net 30\n"
        + "05/01/2024,Ada Gıda,Tahıl,many,12.5,8.0,Immediate\n",
        encoding="utf-8",
    )
    rows = raw_files.read_raw(spark, str(file)).collect()
    assert [str(v) for v in rows[0]] == ["2024-01-05", "Ada Gıda", "Tahıl", "150", "12.5", "8.0", "Net 30"]
    assert rows[1]["transaction_date"] is None and rows[1]["quantity"] is None


def test_load_happens_once(spark, sample, tmp_path):
    path = str(tmp_path / "sales")
    assert not sales_table.has_rows(spark, path)
    assert sales_table.load_if_empty(sample, path)
    assert not sales_table.load_if_empty(sample, path)
    assert sales_table.read_sales(spark, path).count() == 25


def test_default_rows_for_an_empty_table(spark, sample, tmp_path):
    path = str(tmp_path / "sales")
    sample.limit(0).write.parquet(path)
    assert sales_table.load_or_default(spark, path, sample).count() == 25
    assert sales_table.load_or_default(spark, path, sample.limit(3)).count() == 25
    with pytest.raises(ValueError):
        sales_table.load_or_default(spark, str(tmp_path / "none"), sample.limit(0))


def test_input_check(spark, sample):
    assert sales_table.check_input(sample) is sample
    with pytest.raises(TypeError):
        sales_table.check_input([1])
    with pytest.raises(ValueError):
        sales_table.check_input(sample.drop("category"))
    with pytest.raises(TypeError):
        sales_table.check_input(sample.withColumn("quantity", F.lit("5")))
    with pytest.raises(ValueError):
        sales_table.check_input(sample.limit(0))
    with pytest.raises(ValueError):
        run_risk_analysis(sample.limit(0))
    only_bad = run_risk_analysis(sample.withColumn("payment_term", F.lit("x" * 51)))
    assert only_bad["findings"].count() == 0 and only_bad["errors"].count() == 25


def test_outputs_are_written_and_pruned(spark, sample, tmp_path):
    outputs = run_risk_analysis(sample)
    sales_table.write_outputs(outputs, str(tmp_path / "open"), str(tmp_path / "named"))
    with pytest.raises(ValueError, match="folder of their own"):
        sales_table.write_outputs(outputs, str(tmp_path), f"{tmp_path}/")
    findings = spark.read.parquet(str(tmp_path / "open" / "findings")).where("risk_type = 'CHURN_RISK'")
    assert findings.count() == 3
    assert "PartitionFilters: [isnotnull(risk_type" in findings._jdf.queryExecution().executedPlan().toString()
    for name in outputs:
        folder = "named" if name == "inbox" else "open"
        assert spark.read.parquet(str(tmp_path / folder / name)).count() == outputs[name].count()


def test_table_is_created_once(spark, tmp_path):
    name = "sales_records_test"
    location = str(tmp_path / name)
    sales_table.create_sales_table(spark, name, location)
    sales_table.create_sales_table(spark, name, location)
    try:
        fields = {f.name: f.dataType for f in spark.table(name).schema.fields}
        assert fields == {f.name: f.dataType for f in schemas.SALES.fields}
    finally:
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize(
    "url, options",
    [
        ("postgres://u:p%40w@h:5432/db", {"url": "jdbc:postgresql://h:5432/db", "user": "u", "password": "p@w"}),
        ("postgresql://h/db?sslmode=require", {"url": "jdbc:postgresql://h/db?sslmode=require"}),
        ("postgresql+psycopg2://u@h/db", {"url": "jdbc:postgresql://h/db", "user": "u"}),
        ("jdbc:other:x", {"url": "jdbc:other:x"}),
    ],
)
def test_jdbc_options(url, options):
    assert sales_table.jdbc_options(url) == options


def test_jdbc_rejects_other_schemes():
    with pytest.raises(ValueError):
        sales_table.jdbc_options("mysql://h/db")


class FakeSession:
    def __init__(self, root, master):
        self.conf = self
        self.sparkContext = self
        self.root, self.master, self.applicationId = root, master, f"fake-{master}"

    def get(self, _name, default):
        return self.root or default


def test_shared_folder_rules():
    assert storage.shared_root(FakeSession("hdfs://x/cp/", "yarn")) == "hdfs://x/cp"
    with pytest.raises(RuntimeError):
        storage.shared_root(FakeSession(None, "yarn"))
    assert storage.shared_root(FakeSession(None, "local[2]"))


def test_only_changed_parts_are_written_again(spark, sample, tmp_path):
    path = str(tmp_path / "findings")
    findings = RiskRun(sample).findings
    kinds = ["BOTH", "CHURN_RISK", "MARGIN_RISK"]
    files = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("findings/*/*.parquet")}
    assert sales_table.write_parts(findings, path, "risk_type") == kinds
    before = files()
    assert sales_table.write_parts(findings, path, "risk_type") == [] and files() == before
    louder = findings.withColumn("evidence", F.when(F.col("risk_type") == "BOTH", "new").otherwise(F.col("evidence")))
    assert sales_table.write_parts(louder, path, "risk_type") == ["BOTH"]
    kept = {f for f in before if "BOTH" not in str(f)}
    assert {f: t for f, t in files().items() if f in kept} == {f: before[f] for f in kept}
    assert spark.read.parquet(path).where("evidence = 'new'").count() == 1 and spark.read.parquet(path).count() == 6
    assert sales_table.write_parts(findings.where("risk_type != 'BOTH'"), path, "risk_type") == kinds[1:]
    assert spark.read.parquet(path).count() == 5


def test_unreadable_lines_keep_their_text(spark, tmp_path):
    lines = [
        "Date,Customer Name,Category,Quantity,Unit Sales Price,Unit Cost,Payment Term",
        "2024-01-02,A,Kumaş,3,1.5,1.0,Net 30",
        "2024-13-02,A,Kumaş,three,1.5,1.0,Net 30",
        "only,three,values",
        "2024-01-02,A,Kumaş,3,1.5,1.0,Net 30,more",
        "2024-01-03,B,,4,2.5,,Net 30",
    ]
    (tmp_path / "raw.csv").write_text("\n".join(lines), encoding="utf-8")
    found = {r["line"]: (r["file"], r["reasons"]) for r in raw_files.unreadable(spark, str(tmp_path)).collect()}
    assert found == {
        lines[2]: ("raw.csv", ["UNREADABLE_TRANSACTION_DATE", "UNREADABLE_QUANTITY"]),
        lines[3]: ("raw.csv", ["BROKEN_LINE"]),
        lines[4]: ("raw.csv", ["BROKEN_LINE"]),
    }
    assert raw_files.read_raw(spark, str(tmp_path)).count() == 5


def test_sales_by_customer_need_no_shuffle(spark, sample, tmp_path):
    """Sums, windows and the join with the dictionary read the buckets in place."""
    from tidewatch.operators import periods, tokens

    usual = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for name, value in zip(usual, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        sales = sales_table.save_by_customer(sample, "sales_by_customer", str(tmp_path / "sales"), 4)
        totals = periods.period_totals(sales, ["customer_name"])
        trends = periods.period_trends(totals, ["customer_name"])
        for df in (totals, trends, periods.customer_metrics(trends, ["customer_name"])):
            assert "Exchange" not in plan_text(df)
        masked = plan_text(tokens.mask(sales, tokens.build_dictionary(sample)))
        assert masked.count("Exchange hashpartitioning") == 1 and "Exchange" not in masked.split("SortMergeJoin")[0]
        assert {tuple(r) for r in totals.collect()} == {
            tuple(r) for r in periods.period_totals(sample, ["customer_name"]).collect()
        }
    finally:
        spark.sql("DROP TABLE IF EXISTS sales_by_customer")
        for name, value in usual.items():
            spark.conf.set(name, value)
