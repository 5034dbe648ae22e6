"""Plan shapes: skewed keys are split or folded, nothing is crossed, no Python per row."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from backhaul import schemas
from backhaul.adapter import open_tables
from backhaul.checks.queries import QUERIES
from backhaul.operators import merge_upsert, quality, rules
from backhaul.operators.trailing import _with_trailing_count
from backhaul.plans import features, reports, signals, views
from conftest import SF_DIR, day

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    """Rows and the final adaptive plan."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


N = 6000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Returns of which half belong to one customer, one item and one product."""
    root = tmp_path_factory.mktemp("hot")
    half = F.col("id") < N // 2
    returns = spark.range(0, N, 1, 6).select(
        F.col("id").alias("return_id"),
        F.when(half, 1).otherwise(F.col("id")).alias("order_item_id"),
        F.when(half, 1).otherwise(F.col("id") % 500).alias("customer_id"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 997 as int))").alias("return_date"),
        F.lit("changed_mind").alias("return_reason"),
        F.lit("mail").alias("return_channel"),
        F.lit("used").alias("condition_received"),
        F.lit("restock").alias("disposition"),
        F.lit(1).cast("decimal(10,2)").alias("refund_amount"),
        *[F.lit(0).cast("decimal(10,2)").alias(c) for c in ("restocking_fee", "processing_cost", "recovered_value")],
        F.lit(5).alias("cycle_time_hours"),
        (F.col("id") % 3 == 0).alias("fraud_flagged"),
        F.lit(None).cast("decimal(4,3)").alias("fraud_score"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("created_at"),
    )
    items = spark.range(N).select(
        F.col("id").alias("order_item_id"), F.col("id").alias("order_id"), (F.col("id") % 300).alias("product_id"),
        F.lit(1).alias("quantity"), F.lit(1).cast("decimal(10,2)").alias("unit_price"),
    )
    orders = spark.range(N).select(
        F.col("id").alias("order_id"), F.expr("timestamp_ntz'2024-12-30 00:00:00'").alias("order_date")
    )
    frames = {
        "returns": returns,
        "order_items": items,
        "orders": orders,
        "customers": spark.range(500).select(F.col("id").alias("customer_id"), F.lit("vip").alias("segment")),
        "products": spark.range(300).select(F.col("id").alias("product_id"), F.lit("home").alias("category")),
    }
    for name, df in frames.items():
        df.write.parquet(str(root / name))
    return {name: spark.read.parquet(str(root / name)) for name in frames}


def test_hot_item_and_product_are_split(spark, hot):
    with settings(spark, SKEW):
        rows, plan = executed(views.return_reasons_by_category(hot["returns"], hot["order_items"], hot["products"]))
    assert sum(r.return_count for r in rows) == N
    assert plan.count("SortMergeJoin(skew=true)") >= 2


def test_hot_customer_is_split_in_features(spark, hot):
    with settings(spark, SKEW):
        rows, plan = executed(features.training_frame(*[hot[n] for n in ("returns", "order_items", "orders", "customers")]))
    assert len(rows) == N
    assert max(r.customer_lifetime_returns for r in rows) >= N // 2
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "SortMergeJoin" in line]
    assert "_guard" in joins[0] and "skew=true" in joins[0]


def test_hot_customer_is_split_among_high_risk(spark, hot):
    with settings(spark, SKEW):
        rows, plan = executed(views.high_risk_returns(hot["returns"], hot["customers"]))
    assert len(rows) == sum(1 for i in range(N) if i % 3 == 0)
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_customer_is_split_in_trailing_counts(spark, hot):
    with settings(spark, SKEW):
        counted = _with_trailing_count(hot["returns"].select("return_id", "customer_id", "return_date"), 90, None, 100)
        rows, plan = executed(counted)
    # Hot timelines are cut into slices; the list of their customers is all that is broadcast.
    assert "_slice#" in plan
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "LeftSemi" in plan
    # The hot customer's returns lie on 997 consecutive seconds.
    seconds = [i % 997 for i in range(N) if i < N // 2 or i % 500 == 1]
    at = {r.return_id: r.trailing_returns for r in rows}
    assert len(at) == N
    assert all(at[i] == sum(1 for s in seconds if s < i) for i in (0, 1, 500, 996))


def test_hot_instant_is_folded_then_split(spark, hot):
    """Date-only timestamps put half of all returns at one instant of one customer."""
    same = F.when(F.col("return_id") < N // 2, F.lit("2025-02-01").cast("timestamp_ntz")).otherwise(F.col("return_date"))
    returns = hot["returns"].select("return_id", "customer_id", same.alias("return_date"))
    with settings(spark, SKEW):
        rows, plan = executed(_with_trailing_count(returns, 90, None, 100))
    assert "SortMergeJoin(skew=true)" in plan
    at = {r.return_id: r.trailing_returns for r in rows}
    before = sum(1 for i in range(N // 2, N) if i % 500 == 1)
    assert len(at) == N and {at[i] for i in range(N // 2)} == {before}


def test_customer_summary_folds_before_the_join(hot):
    plan = planned(views.customer_return_summary(hot["customers"], hot["returns"]))
    join = plan.index("Join")
    assert join < plan.index("functions=[count(return_id") < plan.index("partial_count(return_id")


def test_upsert_folds_repeated_keys_before_the_shuffle(spark, hot):
    batch = hot["customers"].crossJoin(spark.range(20)).withColumnRenamed("id", "seq")
    batch = batch.withColumns({"email": F.lit("x"), "created_at": F.lit("2025-01-01"), "risk_score": F.lit(0.1)})
    target = spark.createDataFrame([], schemas.CUSTOMERS.schema)
    plan = planned(merge_upsert(target, batch, schemas.CUSTOMERS, "seq"))
    final = plan.index("functions=[max_by")
    assert final < plan.index("Exchange hashpartitioning(customer_id", final) < plan.index("partial_max_by")


def test_a_small_batch_leaves_the_target_where_it_is(spark, hot, tmp_path):
    """No exchange above the target's scans but those of the few keys that it shares with the batch."""
    target = hot["returns"]
    batch = target.where("return_id >= 5990").withColumn("return_id", F.col("return_id") + 5).withColumn("seq", F.lit(0))
    batch.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    few = merge_upsert(target, batch, schemas.RETURNS, "seq", few=True)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        rows, plan = executed(few)
    assert len(rows) == N + 5
    final = plan.split("Initial Plan")[0]
    assert "SortMergeJoin" not in final and "ShuffledHashJoin" not in final
    assert final.count("BroadcastHashJoin") == 3
    # The wide scan of the target reaches the result through its join without an exchange.
    tree = final.splitlines()
    scan = next(i for i, line in enumerate(tree) if "FileScan" in line and "refund_amount" in line and "batch" not in line)
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in tree]
    above, level = [], depth[scan]
    for i in range(scan, -1, -1):
        if depth[i] < level:
            above.append(tree[i])
            level = depth[i]
    assert not [line for line in above if "Exchange" in line]


def test_references_fold_before_the_join(hot):
    plan = planned(quality.foreign_key_violations({n: hot[n] for n in ("returns", "customers", "order_items")}))
    assert plan.count("partial_count(1)") == 2 and "LeftAnti" in plan


def test_reports_push_their_time_bound_to_the_scan(hot):
    plan = planned(reports.disposition_optimization(hot["returns"], hot["order_items"], hot["products"], day("2025-07-01")))
    assert "GreaterThanOrEqual(return_date,2025-01-01T00:00)" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert "order_items" in scans[1] and "ReadSchema: struct<order_item_id:bigint,product_id:bigint>" in scans[1]


def test_point_lookup_reaches_both_scans(hot, spark, seed):
    plan = planned(reports.fraud_investigation(hot["returns"], hot["returns"].select("return_id", *[F.lit("x").alias(c) for c in ("signal_type", "severity", "score", "evidence")]), 7))
    assert plan.count("EqualTo(return_id,7)") == 2


def test_all_rules_share_one_pass(hot):
    tables = [hot[n] for n in ("returns", "order_items", "orders")]
    plan = planned(signals.all_signals(*tables))
    wide_scans = [line for line in plan.splitlines() if "FileScan" in line and "refund_amount" in line]
    assert len(wide_scans) == 1
    assert len(rules.RULES) == 4


LAZY = sorted(set(QUERIES) - {"logistic_regression", "score_returns", "run_etl"})


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = planned(QUERIES[name](open_tables(spark, str(SF_DIR))))
    assert not [bad for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas") if bad in plan]


def test_features_carry_little_to_the_last_shuffle(hot):
    """The join with customers moves no dates, which are days by then, and one bit for a second key."""
    frame = features.training_frame(*[hot[n] for n in ("returns", "order_items", "orders", "customers")])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    moved = plan.split("Join LeftOuter")[1].splitlines()[1]
    assert "AS _guard" in moved and "pmod(" in moved
    assert "AS days_since_purchase" in moved
