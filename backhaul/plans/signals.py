"""Fraud-signal plans over the tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import days_between
from backhaul.operators import rules
from backhaul.operators.joins import join_per_key
from backhaul.operators.upsert import conform, load_time
from backhaul.schemas import FRAUD_SIGNALS


def signal_input(returns: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Returns with the price paid per unit and the days since purchase.

    A return whose item or order is missing stays, with nulls, so the rules that need
    neither still see it.
    """
    items = order_items.select("order_item_id", "order_id", "unit_price")
    purchases = orders.select("order_id", "order_date")
    return (
        returns.join(items, "order_item_id", "left")
        .join(purchases, "order_id", "left")
        .withColumn("days_since_purchase", days_between(F.col("return_date"), F.col("order_date")))
        .select(*returns.columns, "unit_price", "days_since_purchase")
    )


def history_bounds(fresh: DataFrame, window_days: int = rules.SERIAL_WINDOW_DAYS) -> tuple[datetime, datetime] | None:
    """The times between which returns lie that trailing counts of the fresh ones can see: from
    `window_days` before the earliest fresh return to the latest. None if no fresh return is dated."""
    days = fresh.agg(F.min("return_date").alias("first"), F.max("return_date").alias("last")).first()
    return None if days["first"] is None else (days["first"] - timedelta(days=window_days), days["last"])


def all_signals(
    returns: DataFrame, order_items: DataFrame, orders: DataFrame, history: DataFrame | None = None
) -> DataFrame:
    """Every signal of every given return, tagged with the rule-set version.

    Serial returners need no purchase and so run on three columns of the bare returns, counted
    over `history` (default: the given returns; a longer one is cut to the customers at hand).
    The other rules share one pass over the joined input.
    """
    if history is not None and history is not returns:
        customers = returns.select("customer_id").distinct()
        history = join_per_key(history, customers, "customer_id", "left_semi")
    serial = rules.detect_serial_returners(returns, history)
    others = rules.detect(
        signal_input(returns, order_items, orders),
        rules.wardrobing(),
        rules.time_anomaly(),
        rules.value_mismatch(),
    )
    return rules.tagged(serial.unionByName(others))


def signal_log(signals: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """Signals as rows of the append-only log, logged at `created_at` (default: now).

    The id is a hash of what identifies a log row, so no global counter is needed and a
    retried task writes the same id.
    """
    rows = signals.withColumn("created_at", load_time(created_at))
    identity = F.xxhash64("return_id", "signal_type", "model_version", "created_at")
    return conform(rows.withColumn("signal_id", identity), FRAUD_SIGNALS)
