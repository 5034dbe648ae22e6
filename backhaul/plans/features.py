"""Model features per return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.functions import days_between
from backhaul.operators.joins import join_per_key
from backhaul.plans.views import customer_return_summary

# Model inputs.
NUMERIC_FEATURES = (
    "refund_amount",
    "restocking_fee",
    "cycle_time_hours",
    "customer_lifetime_returns",
    "days_since_purchase",
)
CATEGORICAL_FEATURES = ("return_reason", "return_channel", "condition_received")


def _features(
    rows: Column,
    label: list[Column],
    returns: DataFrame,
    order_items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
) -> DataFrame:
    """Features of the returns selected by `rows` whose item and order exist.

    The customer's count covers all of the customer's returns, the current and later ones
    included, whatever `rows` selects. Customers outside the customer table count as 0.
    """
    counts = customer_return_summary(customers, returns).select("customer_id", "lifetime_returns")
    purchases = returns.where(rows).join(
        order_items.select("order_item_id", "order_id"), "order_item_id"
    ).join(orders.select("order_id", "order_date"), "order_id")
    # Only what the result holds goes on to the last shuffle.
    known = purchases.select(
        "return_id",
        "customer_id",
        *label,
        "refund_amount",
        "restocking_fee",
        "cycle_time_hours",
        *CATEGORICAL_FEATURES,
        days_between(F.col("return_date"), F.col("order_date")).alias("days_since_purchase"),
    )
    return join_per_key(known, counts, "customer_id").select(
        *[c for c in known.columns if c != "customer_id"],
        F.coalesce("lifetime_returns", F.lit(0)).alias("customer_lifetime_returns"),
    )


def training_frame(
    returns: DataFrame, order_items: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Features and `label` of every return whose fraud flag is known.

    Scoring overwrites the flag, so after a scoring run the labels include the model's own
    output.
    """
    known = F.col("fraud_flagged").isNotNull()
    label = [F.col("fraud_flagged").alias("label")]
    return _features(known, label, returns, order_items, orders, customers)


def scoring_frame(
    returns: DataFrame, order_items: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Features of every return without a score."""
    return _features(F.col("fraud_score").isNull(), [], returns, order_items, orders, customers)
