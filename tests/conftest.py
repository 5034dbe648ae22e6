from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from backhaul import schemas  # noqa: E402
from backhaul.session import configure  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def day(text: str) -> datetime:
    return datetime.fromisoformat(text)


# Four customers, products, orders, items and returns, small enough to work out by hand.
SEED = {
    "customers": [
        (1, "alice@example.com", "vip", "2023-01-15", "4200.00", "0.02"),
        (2, "bob@example.com", "loyal", "2023-03-22", "1850.00", "0.05"),
        (3, "carol@example.com", "casual", "2024-06-01", "120.00", "0.41"),
        (4, "dan@example.com", "new", "2025-11-10", "45.00", "0.78"),
    ],
    "products": [
        (101, "APP-TEE-001", "apparel", "tops", "29.99", 30),
        (102, "APP-JEA-002", "apparel", "bottoms", "79.99", 30),
        (103, "ELE-PHN-003", "electronics", "phones", "899.00", 14),
        (104, "HOM-LAM-004", "home", "lighting", "54.50", 60),
    ],
    "orders": [
        (1001, 1, "2025-10-01", "web", "29.99", "94110"),
        (1002, 2, "2025-10-15", "mobile", "79.99", "10001"),
        (1003, 3, "2025-12-20", "bopis", "899.00", "60601"),
        (1004, 4, "2025-12-22", "web", "54.50", "94110"),
    ],
    "order_items": [
        (5001, 1001, 101, 1, "29.99", "0"),
        (5002, 1002, 102, 1, "79.99", "0"),
        (5003, 1003, 103, 1, "899.00", "0"),
        (5004, 1004, 104, 1, "54.50", "0"),
    ],
    "returns": [
        (9001, 5001, 1, "2025-10-05", "changed_mind", "mail", "new_unopened", "restock",
         "29.99", "0", "3.50", "26.49", 72, False, None, "2026-01-01"),
        (9002, 5002, 2, "2025-10-25", "wrong_size", "in_store", "opened_unused", "restock",
         "79.99", "0", "5.00", "74.99", 6, False, None, "2026-01-01"),
        (9003, 5003, 3, "2025-12-22", "not_as_described", "pickup", "used", "refurbish",
         "899.00", "0", "35.00", "600.00", 48, False, None, "2026-01-01"),
        (9004, 5004, 4, "2025-12-23", "defective", "mail", "damaged", "destroy",
         "54.50", "0", "8.00", "0", 96, True, None, "2026-01-01"),
    ],
}


class Seed:
    """The seed rows as frames of the table types."""

    def __init__(self, spark):
        self.spark = spark

    def table(self, name):
        schema = schemas.TABLES[name].schema
        text = ", ".join(
            f"{f.name} {'string' if f.dataType.typeName() in ('decimal', 'timestamp_ntz') else f.dataType.simpleString()}"
            for f in schema.fields
        )
        rows = self.spark.createDataFrame(SEED.get(name, []), text)
        return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


@pytest.fixture(scope="session")
def seed(spark):
    return Seed(spark)
