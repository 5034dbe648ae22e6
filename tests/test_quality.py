from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from backhaul.operators import quality
from backhaul.session import configure


def found(report):
    return sorted(tuple(r) for r in report.collect())


def test_clean_tables_have_no_findings(seed):
    frames = {n: seed.table(n) for n in ("customers", "products", "orders", "order_items", "returns", "fraud_signals")}
    assert found(quality.primary_key_violations(frames)) == []
    assert found(quality.unique_violations(frames)) == []
    assert found(quality.foreign_key_violations(frames)) == []
    assert found(quality.domain_violations(frames)) == []
    nulls = quality.not_null_violations(frames).collect()
    # 25 columns declared NOT NULL and 6 keys.
    assert [r.n_nulls for r in nulls] == [0] * 31


def test_keys_may_not_repeat_or_be_null(spark):
    products = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (2, None), (3, None)], "product_id long, sku string")
    keys = {tuple(r) for r in quality.primary_key_violations({"products": products}).collect()}
    assert keys == {("products", "product_id", "1", 2), ("products", "product_id", None, 1)}
    assert found(quality.unique_violations({"products": products})) == [("products", "sku", "b", 2)]


def test_orphans_are_counted_per_key(spark):
    customers = spark.createDataFrame([(1,), (1,)], "customer_id long")
    orders = spark.createDataFrame([(1, 1), (2, 7), (3, 7), (4, None)], "order_id long, customer_id long")
    report = quality.foreign_key_violations({"customers": customers, "orders": orders})
    assert found(report) == [("orders", "customer_id", "7", 2)]


def test_null_counts(spark):
    customers = spark.createDataFrame([(1, None), (None, None)], "customer_id long, segment string")
    report = quality.not_null_violations({"customers": customers})
    assert found(report) == [("customers", "customer_id", 1), ("customers", "segment", 2)]


def test_values_outside_domains_ignore_null(spark):
    returns = spark.createDataFrame([("web", "used"), ("web", None), ("mail", "Used")], "return_channel string, condition_received string")
    assert found(quality.domain_violations({"returns": returns})) == [
        ("returns", "condition_received", "Used", 1),
        ("returns", "return_channel", "web", 2),
    ]


def test_one_report_holds_all_findings(spark, seed):
    clean = {n: seed.table(n) for n in ("customers", "products", "orders", "order_items", "returns", "fraud_signals")}
    assert found(quality.integrity_report(clean)) == []
    frames = {
        "customers": spark.createDataFrame([(1, "vip"), (1, "odd"), (None, None), (None, None)], "customer_id long, segment string"),
        "products": spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "product_id long, sku string"),
        "orders": spark.createDataFrame([(1, 1, "web"), (2, 7, "web"), (3, 7, None), (4, None, "fax")], "order_id long, customer_id long, channel string"),
        "returns": spark.createDataFrame([(1, 99)], "return_id long, order_item_id long"),
    }
    assert sorted(map(str, quality.integrity_report(frames).collect())) == sorted(
        str(Row(rule=a, table_name=b, column_name=c, value=d, n_rows=n))
        for a, b, c, d, n in [
            ("primary_key", "customers", "customer_id", "1", 2), ("primary_key", "customers", "customer_id", None, 2),
            ("domain", "customers", "segment", "odd", 1), ("not_null", "customers", "customer_id", None, 2),
            ("not_null", "customers", "segment", None, 2), ("unique", "products", "sku", "a", 2),
            ("not_null", "products", "sku", None, 1), ("foreign_key", "orders", "customer_id", "7", 2),
            ("not_null", "orders", "customer_id", None, 1), ("not_null", "orders", "channel", None, 1),
            ("domain", "orders", "channel", "fax", 1),
        ]
    )
    # Every table was read once, when its findings were counted.
    plan = quality.integrity_report(clean)._jdf.queryExecution().executedPlan().toString()
    assert "integrity" in plan and "Scan ExistingRDD" not in plan


def test_nothing_to_check_fails(spark):
    with pytest.raises(ValueError, match="no table"):
        quality.integrity_report({})
    with pytest.raises(ValueError):
        quality.unique_violations({"orders": spark.range(1)})


def test_report_joins_nothing_and_writes_findings_only(spark, seed, monkeypatch):
    frames = {n: seed.table(n) for n in ("customers", "products", "orders", "order_items", "returns")}
    orders = frames["orders"].withColumn("customer_id", F.when(F.col("order_id") == 1001, -1).otherwise(F.col("customer_id")))
    plans, keep = [], quality.written

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(quality, "written", kept)
    report = quality.integrity_report({**frames, "orders": orders})
    assert found(report) == [("foreign_key", "orders", "customer_id", "-1", 1)]
    assert len(plans) == 1 and "Join" not in plans[0]
    # One shuffle in all, after rows were counted per value.
    assert plans[0].count("Exchange hashpartitioning") == 1 and "partial_count" in plans[0]


def test_one_task_checks_few_references(spark):
    """A parent's keys reach tasks in bounded parts, whatever the session's number of partitions."""
    one, own = configure(spark.newSession()), spark.newSession()
    assert int(one.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 200
    assert one.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "5m")
    assert configure(own).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "5m"
