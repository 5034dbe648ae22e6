from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from backhaul import schemas
from backhaul.operators import insert_if_absent, merge_upsert, update_scores, upsert
from backhaul.operators.upsert import conform, fill_scores, scored_again
from conftest import day

LOADED = day("2026-02-02")


def merge(seed, name, batch):
    merged = merge_upsert(seed.table(name), batch, schemas.TABLES[name], "seq", LOADED)
    assert merged.columns == schemas.TABLES[name].columns
    assert [f.dataType for f in merged.schema.fields] == [f.dataType for f in schemas.TABLES[name].schema.fields]
    # A small batch may be sent to the target instead: same rows, same types.
    split = merge_upsert(seed.table(name), batch, schemas.TABLES[name], "seq", LOADED, few=True)
    assert [(f.name, f.dataType) for f in split.schema] == [(f.name, f.dataType) for f in merged.schema]
    assert sorted(map(str, split.collect())) == sorted(map(str, merged.collect()))
    return {r[0]: r for r in merged.collect()}


CUSTOMER = "customer_id long, email string, segment string, created_at string, lifetime_value double, risk_score double, seq int"


def test_update_keeps_created_at_and_takes_nulls(spark, seed):
    batch = spark.createDataFrame([(1, None, "loyal", "2030-01-01", 5.005, None, 0)], CUSTOMER)
    out = merge(seed, "customers", batch)
    assert len(out) == 4
    one = out[1]
    assert (one.email, one.segment, one.risk_score) == (None, "loyal", None)
    assert (one.created_at, one.lifetime_value) == (day("2023-01-15"), Decimal("5.01"))
    assert out[2].email == "bob@example.com"


def test_repeated_keys_take_last_update_and_first_insert(spark, seed):
    batch = spark.createDataFrame(
        [
            (9, "a", "new", "2025-01-01", 1.0, 0.1, 0),
            (9, "b", "vip", "2025-02-02", 2.0, None, 1),
            (1, "c", "new", "2030-01-01", 3.0, 0.3, 2),
            (1, None, "vip", "2031-01-01", 4.0, 0.4, 3),
        ],
        CUSTOMER,
    )
    out = merge(seed, "customers", batch)
    assert len(out) == 5
    assert (out[9].email, out[9].segment, out[9].risk_score) == ("b", "vip", None)
    assert out[9].created_at == day("2025-01-01")
    assert (out[1].email, out[1].segment, out[1].created_at) == (None, "vip", day("2023-01-15"))


RETURN = (
    "return_id long, order_item_id long, customer_id long, return_date string, return_reason string, return_channel string, "
    "condition_received string, disposition string, refund_amount double, restocking_fee double, processing_cost double, "
    "recovered_value double, cycle_time_hours int, fraud_flagged boolean, fraud_score double, seq int"
)


def test_returns_update_only_their_own_columns(spark, seed):
    rows = [
        (9001, 1, 1, "2030-01-01", "other", "pickup", "used", None, 1.0, 9.0, 2.0, 3.0, 4, True, 0.9, 0),
        (9999, 5001, 1, "2026-01-05", "late_delivery", "mail", None, None, 1.0, 9.0, 2.0, 3.0, None, False, 0.9, 1),
    ]
    out = merge(seed, "returns", spark.createDataFrame(rows, RETURN))
    old = out[9001]
    assert (old.return_reason, old.return_channel, old.order_item_id) == ("changed_mind", "mail", 5001)
    assert (old.return_date, old.restocking_fee, old.created_at) == (day("2025-10-05"), 0, day("2026-01-01"))
    assert (old.condition_received, old.disposition, old.refund_amount) == ("used", None, 1)
    assert (old.cycle_time_hours, old.fraud_flagged, old.fraud_score) == (4, True, None)
    new = out[9999]
    assert (new.restocking_fee, new.fraud_score, new.created_at) == (9, None, LOADED)


def test_omitted_columns_take_defaults(spark, seed):
    batch = spark.createDataFrame([(1, 2, 3, "2025-01-01", "x", "y", 1.0, 0)],
        "return_id long, order_item_id long, customer_id long, return_date string, return_reason string, return_channel string, refund_amount double, seq int")
    new = merge(seed, "returns", batch)[1]
    assert (new.restocking_fee, new.processing_cost, new.recovered_value, new.fraud_flagged) == (0, 0, 0, False)
    assert (new.disposition, new.cycle_time_hours) == (None, None)


def test_omitting_a_required_column_fails(spark, seed):
    batch = spark.createDataFrame([(1, 0)], "product_id long, seq int")
    with pytest.raises(ValueError, match="sku"):
        merge_upsert(seed.table("products"), batch, schemas.PRODUCTS, "seq")


def test_values_that_do_not_fit_become_null(spark):
    batch = spark.createDataFrame([(float("inf"),), (1e12,), (1.25,)], "unit_price double")
    batch = batch.withColumns({"product_id": F.lit(1), "sku": F.lit("s"), "category": F.lit("home")})
    prices = [r.unit_price for r in conform(batch, schemas.PRODUCTS).collect()]
    assert prices == [None, None, Decimal("1.25")]


@pytest.mark.parametrize("name", ["customers", "products", "orders", "order_items", "returns"])
def test_loading_twice_equals_loading_once(spark, seed, name):
    batch = seed.table(name).withColumn("seq", F.lit(0))
    table = schemas.TABLES[name]
    empty = spark.createDataFrame([], table.schema)
    once = merge_upsert(empty, batch, table, "seq", LOADED)
    twice = merge_upsert(once, batch, table, "seq", day("2027-01-01"))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == 4


def test_null_keys_and_empty_sides_merge_alike(spark, seed):
    rows = [(None, "n", "new", "2025-01-01", 1.0, 0.1, 0), (None, "m", "vip", "2025-01-02", 2.0, 0.2, 1), (7, "s", None, None, None, None, 2)]
    batch, table = spark.createDataFrame(rows, CUSTOMER), schemas.CUSTOMERS
    odd = seed.table("customers").withColumn("customer_id", F.when(F.col("customer_id") > 1, F.col("customer_id")))
    for target in (odd, odd.limit(0)):
        for given in (batch, batch.limit(0)):
            one, two = (merge_upsert(target, given, table, "seq", LOADED, few=few) for few in (False, True))
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_few_rows_are_measured(spark, monkeypatch):
    monkeypatch.setattr(upsert, "FEW_ROWS", 5)
    assert upsert.is_few(spark.range(5)) and not upsert.is_few(spark.range(6)) and upsert.is_few(spark.range(0))


def test_insert_if_absent_keeps_the_first_row_and_known_keys(spark, seed):
    batch = spark.createDataFrame(
        [(1, "x", "new", "2030-01-01", 1.0, 0.1, 0), (8, "first", "new", "2025-01-01", 1.0, 0.1, 1), (8, "second", "vip", "2025-01-02", 2.0, 0.2, 2)],
        CUSTOMER,
    )
    out = {r.customer_id: r for r in insert_if_absent(seed.table("customers"), batch, schemas.CUSTOMERS, "seq").collect()}
    assert len(out) == 5
    assert (out[1].email, out[8].email, out[8].segment) == ("alice@example.com", "first", "new")


def test_scores_touch_only_scored_rows(spark, seed):
    scores = spark.createDataFrame([(9001, "0.812", True), (9004, "0.100", False)], "return_id long, fraud_score string, fraud_flagged boolean")
    scores = scores.withColumn("fraud_score", F.col("fraud_score").cast("decimal(4,3)"))
    out = {r.return_id: (r.fraud_score, r.fraud_flagged) for r in update_scores(seed.table("returns"), scores).collect()}
    assert out == {9001: (Decimal("0.812"), True), 9002: (None, False), 9003: (None, False), 9004: (Decimal("0.100"), False)}


def test_only_returns_without_a_score_move_for_new_scores(spark, tmp_path):
    rows = [(1, None), (1, None), (2, "0.200"), (3, None), (None, None), (None, "0.300")]
    cells = "return_id long, fraud_score string"
    returns = spark.createDataFrame(rows, cells).selectExpr(
        "return_id", "cast(fraud_score as decimal(4,3)) as fraud_score", "return_id = 2 as fraud_flagged"
    )
    scores = spark.createDataFrame([(1, "0.812"), (1, "0.900"), (None, "0.100")], cells).selectExpr(
        "return_id", "cast(fraud_score as decimal(4,3)) as fraud_score", "true as fraud_flagged"
    )
    assert not scored_again(returns, scores)
    filled = fill_scores(returns, scores)
    assert filled.schema == update_scores(returns, scores).schema
    assert sorted(map(str, filled.collect())) == sorted(map(str, update_scores(returns, scores).collect()))
    # Rows that have a score do not come to the join.
    returns.write.parquet(f"{tmp_path}/returns")
    moved = fill_scores(spark.read.parquet(f"{tmp_path}/returns"), scores)
    below = moved._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "isnull(fraud_score" in below
    # A score for a return that has one concerns its rows of either kind.
    again = scores.unionByName(scores.limit(1).withColumn("return_id", F.lit(2).cast("long")))
    assert scored_again(returns, again)
