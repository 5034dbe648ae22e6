"""Analyst reports. `as_of` stands in for the current time; None means now."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import month_of, trailing_months
from backhaul.plans.views import with_category


def disposition_optimization(
    returns: DataFrame, order_items: DataFrame, products: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """Net value per category and disposition over the trailing 6 months, best first."""
    recent = returns.where(
        F.col("disposition").isNotNull() & trailing_months(F.col("return_date"), 6, as_of)
    )
    recovered, cost = F.sum("recovered_value"), F.sum("processing_cost")
    return (
        with_category(recent, order_items, products)
        .groupBy("category", "disposition")
        .agg(
            F.count("*").alias("units"),
            recovered.alias("recovered_revenue"),
            cost.alias("processing_cost"),
            (recovered - cost).alias("net_value"),
            F.avg("cycle_time_hours").alias("avg_cycle_hours"),
        )
        .orderBy(F.col("category").asc_nulls_last(), F.col("net_value").desc_nulls_first())
    )


def return_reasons_breakdown(
    returns: DataFrame, order_items: DataFrame, products: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """Returns and refunds per month, category and reason over the trailing 12 months."""
    recent = returns.where(trailing_months(F.col("return_date"), 12, as_of))
    return (
        with_category(recent, order_items, products)
        .groupBy(month_of(F.col("return_date")).alias("month"), "category", "return_reason")
        .agg(
            F.count("*").alias("return_count"),
            F.sum("refund_amount").alias("refund_dollars"),
            F.avg("cycle_time_hours").alias("avg_cycle_hours"),
        )
        .orderBy(F.col("month").desc_nulls_first(), F.col("return_count").desc_nulls_first())
    )


def fraud_investigation(returns: DataFrame, fraud_signals: DataFrame, return_id: int) -> DataFrame:
    """Every signal behind one return; one row with null signal columns if it has none."""
    signals = fraud_signals.select(
        "return_id", "signal_type", "severity", F.col("score").alias("signal_score"), "evidence"
    )
    return (
        returns.where(F.col("return_id") == return_id)
        .join(signals, "return_id", "left")
        .select(
            "return_id",
            "return_date",
            "refund_amount",
            "return_reason",
            "return_channel",
            "condition_received",
            "fraud_score",
            "signal_type",
            "severity",
            "signal_score",
            "evidence",
        )
        .orderBy(F.col("signal_type").asc_nulls_last())
    )
