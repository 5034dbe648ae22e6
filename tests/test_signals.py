from __future__ import annotations

import json
from datetime import timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from backhaul import schemas
from backhaul.operators import rules
from backhaul.operators.trailing import HOT, _with_trailing_count
from backhaul.plans import signals
from backhaul.sources.warehouse import Warehouse, day_column
from conftest import day

FIXTURE = "return_id long, customer_id long, return_date timestamp_ntz, return_reason string, return_channel string, refund_amount double, unit_price double"


@pytest.fixture
def daily(spark):
    start = day("2025-01-01")
    return spark.createDataFrame(
        [(100 + i, 1, start + timedelta(days=i), "changed_mind", "web", 50.0, 50.0) for i in range(7)], FIXTURE
    )


def history(spark, rows):
    return spark.createDataFrame(rows, "return_id long, customer_id long, return_date timestamp_ntz")


def counts(df, days=90, history=None, hot=HOT):
    rows = _with_trailing_count(df, days, history, hot).collect()
    assert len(rows) == df.count()
    return {r.return_id: r.trailing_returns for r in rows}


# Every timeline whole, only long ones cut, every one cut.
hot_limits = pytest.mark.parametrize("hot", [10**6, 40, 0])


def test_seventh_daily_return_is_serial(daily):
    out = rules.detect_serial_returners(daily).collect()
    assert [(r.return_id, r.signal_type, r.severity, r.score) for r in out] == [(106, "serial_returner", "medium", 0.4)]
    assert json.loads(out[0].evidence) == {"returns_in_window": 6, "window_days": 90}


def test_severity_steps(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 6, 10, 11, 15, 40])], "return_id long, trailing_returns long")
    out = {r.return_id: (r.severity, round(r.score, 4)) for r in rules.detect(df, rules.serial_returner()).collect()}
    assert out == {1: ("medium", 0.4), 2: ("medium", 0.6667), 3: ("high", 0.7333), 4: ("high", 1.0), 5: ("high", 1.0)}


def test_mismatch_is_strict(spark):
    t = day("2025-01-01")
    df = spark.createDataFrame([(1, 1, t, "defective", "web", 200.0, 100.0), (2, 1, t, "defective", "web", 50.0, 50.0), (3, 1, t, "x", "web", 9.0, None)], FIXTURE)
    out = rules.detect_value_mismatch(df).collect()
    assert [(r.return_id, r.severity, r.score) for r in out] == [(1, "high", 0.95)]
    assert json.loads(out[0].evidence) == {"refund_amount": 200.0, "unit_price": 100.0}


def test_off_hours(spark):
    times = ["02:00:00", "12:00:00", "23:30:00", "22:59:59", "23:00:00", "03:59:59", "04:00:00", "00:00:00"]
    df = spark.createDataFrame([(i + 1, day(f"2025-01-01T{t}")) for i, t in enumerate(times)], "return_id long, return_date timestamp_ntz")
    out = rules.detect_late_night_returns(df).collect()
    assert sorted(r.return_id for r in out) == [1, 3, 5, 6, 8]
    assert {r.evidence for r in out if r.return_id == 8} == {'{"return_date":"2025-01-01 00:00:00"}'}
    assert sorted(r.return_id for r in rules.detect_late_night_returns(df, skip_midnight=True).collect()) == [1, 3, 5, 6]


def test_wardrobing_window(spark):
    data = [(1, 1.0, "changed_mind"), (2, 3.0, "not_as_described"), (3, 3.0001, "changed_mind"), (4, 0.9999, "changed_mind"), (5, 2.7, "defective"), (6, None, "changed_mind"), (7, 2.7, "changed_mind")]
    df = spark.createDataFrame(data, "return_id long, days_since_purchase double, return_reason string")
    out = {r.return_id: json.loads(r.evidence) for r in rules.detect_wardrobing(df).collect()}
    assert out == {1: {"days_since_purchase": 1}, 2: {"days_since_purchase": 3}, 7: {"days_since_purchase": 2}}


def test_all_rules_together(daily):
    out = rules.compute_all_signals(daily.withColumn("days_since_purchase", F.lit(2))).collect()
    assert {r.model_version for r in out} == {"rules_v1"}
    kinds = [r.signal_type for r in out]
    assert {k: kinds.count(k) for k in kinds} == {"serial_returner": 1, "wardrobing": 7, "time_anomaly": 7}


def test_missing_columns_silence_a_rule(spark):
    df = spark.range(3).withColumnRenamed("id", "return_id")
    for found in (rules.detect_wardrobing(df), rules.detect_value_mismatch(df)):
        assert found.schema == rules.SIGNAL_SCHEMA
        assert found.count() == 0


def test_no_hits_give_an_empty_typed_frame(spark):
    df = history(spark, [(1, 1, day("2025-01-01T12:00:00"))])
    out = rules.compute_all_signals(df)
    assert out.columns == [*rules.SIGNAL_SCHEMA.fieldNames(), "model_version"]
    assert out.count() == 0


def test_own_rules_can_be_plugged_in(spark):
    late = rules.Rule("condition_mismatch", ("x",), F.col("x") > 1, F.lit("low"), F.lit(0.1), F.struct("x"))
    df = spark.createDataFrame([(1, 1), (2, 2)], "return_id long, x int")
    assert [(r.return_id, r.evidence) for r in rules.compute_all_signals(df, rules=[late]).collect()] == [(2, '{"x":2}')]


@hot_limits
def test_window_edges(spark, hot):
    t = day("2025-06-01T10:30:00.000007")
    micro = timedelta(microseconds=1)
    df = history(spark, [(1, 1, t), (2, 1, t - timedelta(days=90)), (3, 1, t - timedelta(days=90) - micro), (4, 1, t), (5, 1, t - micro), (6, 2, t - micro)])
    assert counts(df, hot=hot) == {1: 2, 4: 2, 5: 2, 2: 1, 3: 0, 6: 0}


@hot_limits
def test_null_customer_or_date_counts_zero(spark, hot):
    t = day("2025-06-01")
    df = history(spark, [(1, None, t), (2, None, t + timedelta(1)), (3, 1, None), (4, 1, t), (5, 1, t + timedelta(1))])
    assert counts(df, hot=hot) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def scattered(seed, step, n=400):
    """One customer holds most rows; many share an instant; times fall before and after 1970."""
    random = Random(seed)
    rows = []
    for i in range(n):
        customer = 1 if random.random() < 0.6 else random.randint(2, 20)
        offset = step * random.randint(0, 300) + timedelta(days=random.choice([0, 0, 30, 90]))
        rows.append((i, customer, day("1969-12-20") + offset))
    return rows


def brute_force(rows, past):
    span = timedelta(days=90)
    return {i: sum(1 for _, c, s in past if c == customer and t - span <= s < t) for i, customer, t in rows}


@hot_limits
@pytest.mark.parametrize("seed, step", [(1, timedelta(hours=7)), (2, timedelta(seconds=13)), (3, timedelta(days=3)), (4, timedelta(microseconds=1))])
def test_counts_equal_brute_force(spark, seed, step, hot):
    rows = scattered(seed, step)
    assert counts(history(spark, rows), hot=hot) == brute_force(rows, rows)


@hot_limits
def test_counts_over_another_history(spark, hot):
    rows, past = scattered(5, timedelta(hours=9), 150), scattered(6, timedelta(hours=9))
    got = counts(history(spark, rows), history=history(spark, past), hot=hot)
    assert got == brute_force(rows, past)


@hot_limits
def test_shorter_window(spark, hot):
    t = day("2025-01-10")
    df = history(spark, [(i, 1, t + timedelta(days=i)) for i in range(10)])
    got = counts(df, days=3, hot=hot)
    assert [got[i] for i in range(10)] == [0, 1, 2, 3, 3, 3, 3, 3, 3, 3]


def test_seed_signals(seed):
    tables = [seed.table(n) for n in ("returns", "order_items", "orders")]
    found = sorted((r.return_id, r.signal_type) for r in signals.all_signals(*tables).collect())
    assert found == [(9001, "time_anomaly"), (9002, "time_anomaly"), (9003, "time_anomaly"), (9003, "wardrobing"), (9004, "time_anomaly")]


def test_returns_without_item_keep_their_other_signals(seed):
    tables = [seed.table("returns"), seed.table("order_items").where("order_item_id <> 5003"), seed.table("orders")]
    found = sorted((r.return_id, r.signal_type) for r in signals.all_signals(*tables).collect())
    assert (9003, "time_anomaly") in found and (9003, "wardrobing") not in found


def test_recent_returns_see_their_whole_history(spark, seed, daily):
    last = daily.where("return_id = 106").drop("unit_price").withColumn("order_item_id", F.lit(1).cast("long"))
    found = signals.all_signals(last, seed.table("order_items"), seed.table("orders"), history=daily)
    assert sorted(r.signal_type for r in found.collect()) == ["serial_returner", "time_anomaly"]


def test_log_rows(spark, daily):
    found = rules.compute_all_signals(daily)
    log = signals.signal_log(found, day("2025-02-01"))
    again = signals.signal_log(found, day("2025-02-01"))
    later = signals.signal_log(found, day("2025-02-02"))
    ids = {r.signal_id for r in log.collect()}
    assert len(ids) == log.count() == 8
    assert ids == {r.signal_id for r in again.collect()}
    assert not ids & {r.signal_id for r in later.collect()}
    assert [f.dataType.simpleString() for f in log.schema.fields][4] == "decimal(4,3)"


def test_hourly_signals_open_only_the_history_in_sight(spark, seed, tmp_path):
    """Row groups of other days are skipped, and counts are those over the whole history."""
    start = day("2020-01-01")
    rows = [(i, i % 40, start + timedelta(days=i % 1800, hours=i % 7)) for i in range(20_000)]
    made = history(spark, rows).repartitionByRange(20, "return_date")
    fill = {f.name: F.lit(None).cast(f.dataType) for f in schemas.RETURNS.schema if f.name not in made.columns}
    returns = made.withColumns({**fill, "created_at": F.col("return_date")}).select(*schemas.RETURNS.columns)
    store = Warehouse(spark, str(tmp_path / "wh"))
    with_days = returns.withColumns({day_column(c): F.to_date(c) for c in ("return_date", "created_at")})
    with_days.sortWithinPartitions("return_date").write.parquet(store.location("returns"))

    fresh = store.between("returns", "created_at", day("2024-11-01"))
    bounds = signals.history_bounds(fresh)
    seen = store.between("returns", "return_date", *bounds)
    assert bounds == (day("2024-11-01") - timedelta(days=90), max(r[2] for r in rows))
    at_all, at_seen = (counts(fresh, history=h) for h in (store.table("returns"), seen))
    assert at_all == at_seen and max(at_all.values()) > 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.between("returns", "return_date", *bounds)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual(return_date_day,{bounds[0].date()})" in plan

    def rows_scanned(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scanned = {}
        for name, df in (("fresh", fresh), ("seen", seen), ("all", store.table("returns"))):
            df = df.select("return_id")
            scanned[name] = rows_scanned(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scanned["all"] == 20_000 and scanned["seen"] < 4000 and scanned["fresh"] < 3000

    undated = fresh.withColumn("return_date", F.lit(None).cast("timestamp_ntz"))
    assert signals.history_bounds(undated) is None and signals.history_bounds(fresh.limit(0)) is None
    # Tables without days are filtered all the same.
    other = Warehouse(spark, str(tmp_path / "other"))
    returns.write.parquet(other.location("returns"))
    assert other.between("returns", "return_date", *bounds).count() == seen.count() > 0
    assert Warehouse(spark, str(tmp_path / "none")).between("returns", "return_date", start).count() == 0


def test_written_tables_keep_their_days_to_themselves(spark, seed, tmp_path):
    store = Warehouse(spark, str(tmp_path / "wh"))
    store.write("returns", seed.table("returns"))
    assert store.table("returns").columns == schemas.RETURNS.columns
    late = store.between("returns", "return_date", day("2025-12-22"), day("2025-12-22"))
    assert [r.return_id for r in late.collect()] == [9003] and late.columns == schemas.RETURNS.columns
    assert "return_date_day" in spark.read.parquet(store.location("returns")).columns
