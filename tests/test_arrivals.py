from types import SimpleNamespace

from helpers import plan_text
from pyspark.sql import functions as F

from tidewatch.plans import catalog


def test_arrivals_are_cut_from_one_table(spark, sample, monkeypatch):
    """Numbered rows are not written again before each arrival writes its own; they keep their ids."""
    stored = []
    monkeypatch.setattr(catalog, "store", lambda df, label: stored.append(label) or df)
    desk = SimpleNamespace(sales=sample.drop("id").withColumn("customer_key", F.col("customer_name")))
    rows = catalog.numbered_sales(desk)
    assert stored == ["sales"] and rows.columns == sample.columns
    part = catalog.between("2023-07-01", "2023-12-31")(rows)
    assert "GreaterThanOrEqual(transaction_date,2023-07-01)" in plan_text(part)
    ids = [r["id"] for r in rows.orderBy("transaction_date", "customer_name", "category").collect()]
    assert ids == [*range(1, sample.count() + 1)]
