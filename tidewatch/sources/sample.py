"""Labelled sales rows of our own: default content of an empty table, and test input.

Seven invented customers; together they reach every class and every severity.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tidewatch.schemas import SALES

EXPECTED = {
    "Fener Halat Ltd.": "CHURN_RISK",
    "Kestane Mobilya A.Ş.": "MARGIN_RISK",
    "İncir Gıda Ltd.": "BOTH",
    "Söğüt Optik A.Ş.": None,
    "Martı Seramik Ltd.": "CHURN_RISK",
    "Zeytin Yapı A.Ş.": "MARGIN_RISK",
    "Pelit Kırtasiye Ltd.": "CHURN_RISK",
}

# name, category, then rows: year, month, day, quantity, price, cost, term
_ROWS = [
    ("Fener Halat Ltd.", "Halat", (2023, 2, 6, 240, 41.0, 27.5, "Net 20"), (2023, 5, 16, 205, 41.5, 27.8, "Net 20"), (2023, 8, 24, 96, 42.0, 28.1, "Net 35"), (2023, 11, 13, 52, 42.0, 28.3, "Net 35")),
    ("Kestane Mobilya A.Ş.", "Mobilya", (2023, 1, 11, 64, 128.0, 84.0, "Net 40"), (2023, 4, 27, 70, 129.5, 97.0, "Net 40"), (2023, 9, 4, 66, 131.0, 121.5, "Net 40")),
    ("İncir Gıda Ltd.", "Kuru Meyve", (2023, 3, 21, 1500, 9.6, 6.1, "Net 10"), (2023, 6, 2, 1210, 9.8, 7.4, "Net 10"), (2023, 7, 17, 830, 10.1, 9.0, "Net 25"), (2023, 12, 19, 640, 10.4, 9.5, "Net 25")),
    ("Söğüt Optik A.Ş.", "Mercek", (2023, 1, 30, 33, 402.0, 251.0, "Immediate"), (2023, 5, 9, 36, 405.0, 252.5, "Immediate"), (2023, 10, 3, 35, 411.0, 256.0, "Immediate")),
    ("Martı Seramik Ltd.", "Karo", (2023, 2, 15, 410, 66.0, 43.0, "Net 50"), (2023, 6, 28, 425, 67.0, 43.5, "Net 50"), (2023, 8, 1, 431, 67.5, 44.0, "Net 50"), (2023, 10, 25, 108, 68.0, 44.2, "Net 50")),
    ("Zeytin Yapı A.Ş.", "Çatı", (2023, 3, 7, 88, 240.0, 198.0, "Net 40"), (2023, 7, 31, 91, 244.0, 205.0, "Net 40"), (2023, 11, 29, 90, 246.0, 212.0, "Net 40")),
    ("Pelit Kırtasiye Ltd.", "Kâğıt", (2023, 1, 18, 700, 5.2, 3.4, "Net 15"), (2023, 4, 5, 640, 5.2, 3.4, "Net 15"), (2023, 9, 12, 520, 5.3, 3.45, "Net 15"), (2023, 12, 6, 430, 5.3, 3.5, "Net 15")),
]


def sample_sales(spark: SparkSession) -> DataFrame:
    rows = [
        (date(year, month, day), name, category, quantity, price, cost, term)
        for name, category, *lines in _ROWS
        for year, month, day, quantity, price, cost, term in lines
    ]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows, 1)], SALES)
