from __future__ import annotations

from backhaul.operators import dedupe_returns
from backhaul.plans.cleaning import transform_returns
from conftest import day


def rows(spark, data, columns="return_id long, return_date string, seq int"):
    df = spark.createDataFrame(data, columns)
    return df.withColumn("return_date", df.return_date.cast("timestamp_ntz"))


def test_latest_row_wins(spark):
    df = rows(spark, [(1, "2025-01-01", 0), (1, "2025-01-05", 1), (2, "2025-01-02", 2)])
    kept = {r.return_id: r.return_date for r in dedupe_returns(df, "seq").collect()}
    assert kept == {1: day("2025-01-05"), 2: day("2025-01-02")}


def test_later_row_wins_ties_and_null_date_wins(spark):
    df = rows(spark, [(1, "2025-01-05", 0), (1, "2025-01-05", 3), (2, None, 1), (2, "2025-01-02", 2), (None, None, 4), (None, None, 5)])
    assert {r.return_id: r.seq for r in dedupe_returns(df, "seq").collect()} == {1: 3, 2: 1, None: 5}


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = rows(spark, [(1, "2025-01-01", 0)])
    plan = dedupe_returns(df, "seq")._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 1, Partial")
    assert plan.index("row_number(), 1, Final") < plan.index("Exchange") < partial


RAW = "return_id long, return_date string, return_reason string, condition_received string, refund_amount string"


def test_pipeline_fills_what_is_missing(spark):
    df = rows(spark, [(1, "2025-01-01", "Broken", "New", "10.555", 0)], RAW + ", seq int")
    out = transform_returns(df, "seq").first().asDict()
    assert out == {
        "return_id": 1, "return_date": day("2025-01-01"), "return_reason": "defective",
        "condition_received": "new_unopened", "refund_amount": 10.56, "seq": 0,
        "fraud_flagged": False, "disposition": None,
    }


def test_pipeline_coerces_present_columns(spark):
    data = [(1, "2025-01-01", None, None, None, "7", "x", None, "True", "restock", 0)]
    schema = RAW + ", restocking_fee string, processing_cost string, recovered_value string, fraud_flagged string, disposition string, seq int"
    out = transform_returns(rows(spark, data, schema), "seq").first()
    assert (out.return_reason, out.condition_received, out.refund_amount) == ("other", "used", 0.0)
    assert (out.restocking_fee, out.processing_cost, out.recovered_value) == (7.0, 0.0, 0.0)
    assert (out.fraud_flagged, out.disposition) == (True, "restock")


def test_one_row_per_return(spark):
    data = [(i % 10, f"2025-01-{1 + i % 28:02d}", "late", "new", "1", i) for i in range(200)]
    out = transform_returns(rows(spark, data, RAW + ", seq int"), "seq")
    assert out.count() == out.select("return_id").distinct().count() == 10
