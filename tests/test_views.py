"""Seed results, worked out by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from backhaul.plans import reports, views
from conftest import day

D = Decimal


def test_rolling_return_rate_counts_quiet_days(spark, seed):
    tables = [seed.table(n) for n in ("returns", "order_items", "orders")]
    out = {(str(r.day), r.window_days): r for r in views.kpi_return_rate_rolling(*tables, days=(1, 7)).collect()}
    # From the first order, 1 October, to the last return, 23 December.
    assert len(out) == 2 * 84
    assert tuple(out["2025-10-01", 1])[2:] == (0, 1, 0.0)
    assert tuple(out["2025-10-05", 1])[2:] == (1, 0, None)
    assert tuple(out["2025-10-07", 7])[2:] == (1, 1, 1.0)
    assert tuple(out["2025-10-08", 7])[2:] == (1, 0, None)
    assert tuple(out["2025-11-20", 7])[2:] == (0, 0, None)
    assert tuple(out["2025-12-23", 7])[2:] == (2, 2, 1.0)
    days = sorted(d for d, n in out if n == 7)
    assert days[0] == "2025-10-01" and days[-1] == "2025-12-23" and len(set(days)) == 84


def test_rolling_return_rate_of_nothing(spark, seed):
    returns, items, orders = [seed.table(n) for n in ("returns", "order_items", "orders")]
    undated = returns.withColumn("return_date", F.lit(None).cast("timestamp_ntz"))
    assert views.kpi_return_rate_rolling(returns.limit(0), items.limit(0), orders).count() == 0
    assert views.kpi_return_rate_rolling(undated, items.limit(0), orders).count() == 0
    with pytest.raises(ValueError, match="one day"):
        views.kpi_return_rate_rolling(returns, items, orders, days=(30, 0))


def test_return_rate_over_a_chosen_window(seed):
    tables = [seed.table(n) for n in ("returns", "order_items", "orders")]
    between = lambda low, high: tuple(views.kpi_return_rate_between(*tables, day(low).date(), day(high).date()).first())
    assert between("2025-10-01", "2025-11-01") == (2, 2, 1.0)
    assert between("2025-10-25", "2025-12-21") == (1, 1, 1.0)
    assert between("2025-10-05", "2025-10-06") == (1, 0, None)
    assert between("2020-01-01", "2020-01-02") == (0, 0, None)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_monthly_metrics(seed):
    out = rows(views.VIEWS["v_monthly_return_metrics"](seed))
    assert out == [
        (day("2025-10-01"), 2, D("109.98"), 39.0, 0.0, D("101.48"), D("8.50")),
        (day("2025-12-01"), 2, D("953.50"), 72.0, 0.5, D("600.00"), D("43.00")),
    ]


def test_reasons_by_category(seed):
    out = rows(views.VIEWS["v_return_reasons_by_category"](seed))
    assert out == [
        ("apparel", "changed_mind", day("2025-10-01"), 1, D("29.99")),
        ("apparel", "wrong_size", day("2025-10-01"), 1, D("79.99")),
        ("electronics", "not_as_described", day("2025-12-01"), 1, D("899.00")),
        ("home", "defective", day("2025-12-01"), 1, D("54.50")),
    ]


def test_disposition_outcomes(seed):
    assert rows(views.VIEWS["v_disposition_outcomes"](seed)) == [
        ("apparel", "restock", 2, D("101.48"), D("8.50"), D("92.98")),
        ("electronics", "refurbish", 1, D("600.00"), D("35.00"), D("565.00")),
        ("home", "destroy", 1, D("0.00"), D("8.00"), D("-8.00")),
    ]


def test_customer_summary(seed):
    out = rows(views.VIEWS["v_customer_return_summary"](seed))
    assert [(r[0], r[2], r[3], r[4]) for r in out] == [
        (1, 1, D("29.99"), 0), (2, 1, D("79.99"), 0), (3, 1, D("899.00"), 0), (4, 1, D("54.50"), 1),
    ]
    lonely = views.customer_return_summary(seed.table("customers"), seed.table("returns").where("false")).first()
    assert (lonely.lifetime_returns, lonely.lifetime_refunds, lonely.flagged_returns, lonely.last_return_date) == (0, None, 0, None)


def test_high_risk(spark, seed):
    assert [r.return_id for r in views.VIEWS["v_high_risk_returns"](seed).collect()] == [9004]
    from pyspark.sql import functions as F

    scored = seed.table("returns").withColumn(
        "fraud_score", F.when(F.col("return_id") == 9001, "0.700").when(F.col("return_id") == 9002, "0.699").cast("decimal(4,3)")
    ).withColumn("fraud_flagged", F.when(F.col("return_id") != 9002, F.col("fraud_flagged")))
    out = views.high_risk_returns(scored, seed.table("customers"))
    assert sorted(r.return_id for r in out.collect()) == [9001, 9004]


def test_kpis(seed):
    head = views.kpi_headline(seed.table("returns")).first()
    assert head.fraud_rate == 0.25
    assert float(head.recovery_rate) == pytest.approx(701.48 / 1063.48, abs=1e-6)
    assert (head.net_return_cost, head.cycle_time_hours) == (D("413.50"), 55.5)
    rate = rows(views.kpi_return_rate(seed.table("returns"), seed.table("order_items"), seed.table("orders")))
    assert rate == [(day("2025-10-01"), 2, 2, 1.0), (day("2025-12-01"), 2, 2, 1.0)]


def test_empty_tables_give_no_rows_or_null_figures(seed):
    none = seed.table("returns").where("false")
    assert views.monthly_return_metrics(none).count() == 0
    assert tuple(views.kpi_headline(none).first()) == (None, None, None, None)


def test_order_totals(seed):
    assert rows(views.order_totals(seed.table("order_items")))[0] == (1001, D("29.99"))


def test_disposition_report(seed):
    tables = [seed.table(n) for n in ("returns", "order_items", "products")]
    out = [tuple(r)[:3] for r in reports.disposition_optimization(*tables, day("2026-01-10")).collect()]
    assert out == [("apparel", "restock", 2), ("electronics", "refurbish", 1), ("home", "destroy", 1)]
    late = reports.disposition_optimization(*tables, day("2026-05-20")).collect()
    assert [r.category for r in late] == ["electronics", "home"]
    assert reports.disposition_optimization(*tables, day("2027-01-01")).count() == 0


def test_reasons_report_is_ordered(seed):
    tables = [seed.table(n) for n in ("returns", "order_items", "products")]
    out = reports.return_reasons_breakdown(*tables, day("2026-01-10")).collect()
    assert [r.month for r in out] == [day("2025-12-01")] * 2 + [day("2025-10-01")] * 2
    assert {r.avg_cycle_hours for r in out} == {72.0, 6.0, 48.0, 96.0}


def test_investigation_of_a_return_without_signals(seed):
    out = reports.fraud_investigation(seed.table("returns"), seed.table("fraud_signals"), 9001).collect()
    assert len(out) == 1
    assert (out[0].return_id, out[0].signal_type, out[0].evidence) == (9001, None, None)
