"""KPI views and KPI figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.functions import month_of

HIGH_RISK_SCORE = "0.7"
ROLLING_DAYS = (30, 90)


def flagged_count() -> Column:
    return F.sum(F.when(F.col("fraud_flagged"), 1).otherwise(0))


def with_category(returns: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Returns with the category of the returned product.

    No broadcast hint: Spark broadcasts products while their measured size is below its
    threshold, and otherwise shuffles both sides and lets AQE split hot items or products.
    """
    return returns.join(order_items.select("order_item_id", "product_id"), "order_item_id").join(
        products.select("product_id", "category"), "product_id"
    )


def monthly_return_metrics(returns: DataFrame) -> DataFrame:
    """`v_monthly_return_metrics`: volume, refunds, fraud rate, recovery and cost per month."""
    return returns.groupBy(month_of(F.col("return_date")).alias("month")).agg(
        F.count("*").alias("total_returns"),
        F.sum("refund_amount").alias("total_refunds"),
        F.avg("cycle_time_hours").alias("avg_cycle_hours"),
        F.try_divide(flagged_count(), F.count("*")).alias("fraud_rate"),
        F.sum("recovered_value").alias("total_recovered"),
        F.sum("processing_cost").alias("total_processing_cost"),
    )


def return_reasons_by_category(returns: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """`v_return_reasons_by_category`: returns and refunds per category, reason and month."""
    return (
        with_category(returns, order_items, products)
        .groupBy("category", "return_reason", month_of(F.col("return_date")).alias("month"))
        .agg(F.count("*").alias("return_count"), F.sum("refund_amount").alias("refund_amount"))
    )


def disposition_outcomes(returns: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """`v_disposition_outcomes`: value recovered and spent per category and disposition."""
    recovered, cost = F.sum("recovered_value"), F.sum("processing_cost")
    return (
        with_category(returns.where(F.col("disposition").isNotNull()), order_items, products)
        .groupBy("category", "disposition")
        .agg(
            F.count("*").alias("disposition_count"),
            recovered.alias("recovered_value"),
            cost.alias("processing_cost"),
            (recovered - cost).alias("net_value"),
        )
    )


def customer_return_summary(customers: DataFrame, returns: DataFrame) -> DataFrame:
    """`v_customer_return_summary`: all-time return behaviour, one row per customer.

    Returns are folded per customer before the join, so a customer with very many returns
    joins as one row.
    """
    per_customer = returns.groupBy("customer_id").agg(
        F.count("return_id").alias("lifetime_returns"),
        F.sum("refund_amount").alias("lifetime_refunds"),
        flagged_count().alias("flagged_returns"),
        F.max("return_date").alias("last_return_date"),
    )
    return (
        customers.select("customer_id", "segment")
        .join(per_customer, "customer_id", "left")
        .na.fill(0, ["lifetime_returns", "flagged_returns"])
    )


def high_risk_returns(returns: DataFrame, customers: DataFrame) -> DataFrame:
    """`v_high_risk_returns`: flagged returns and stored scores from 0.7 up."""
    risky = F.col("fraud_flagged") | (F.col("fraud_score") >= F.lit(HIGH_RISK_SCORE).cast("decimal(4,3)"))
    return (
        returns.where(risky)
        .join(customers.select("customer_id", "segment"), "customer_id")
        .select(
            "return_id",
            "return_date",
            "customer_id",
            "segment",
            "refund_amount",
            "return_reason",
            "return_channel",
            "fraud_score",
            "fraud_flagged",
        )
    )


def order_totals(order_items: DataFrame) -> DataFrame:
    """Order total: sum of quantity times unit price."""
    total = F.sum(F.col("quantity") * F.col("unit_price"))
    return order_items.groupBy("order_id").agg(total.alias("total_amount"))


def kpi_return_rate(returns: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Returns per item sold, by calendar month.

    Returns count in the month of their `return_date`, items in the month of their order's
    `order_date`. A month without items has a null rate.
    """
    returned = returns.groupBy(month_of(F.col("return_date")).alias("month")).agg(
        F.count("*").alias("returns")
    )
    sold = (
        order_items.groupBy("order_id")
        .agg(F.count("*").alias("items"))
        .join(orders.select("order_id", "order_date"), "order_id")
        .groupBy(month_of(F.col("order_date")).alias("month"))
        .agg(F.sum("items").alias("items"))
    )
    return (
        returned.join(sold, "month", "full_outer")
        .na.fill(0, ["returns", "items"])
        .withColumn("return_rate", F.try_divide(F.col("returns"), F.col("items")))
    )


def _items_by_day(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """day and items sold on it; an order's items are counted before they meet it."""
    per_order = order_items.groupBy("order_id").agg(F.count("*").alias("items"))
    dated = per_order.join(orders.select("order_id", F.to_date("order_date").alias("day")), "order_id")
    return dated.groupBy("day").agg(F.sum("items").alias("items"))


def kpi_return_rate_between(
    returns: DataFrame, order_items: DataFrame, orders: DataFrame, start: date, end: date
) -> DataFrame:
    """Returns per item sold from `start` up to the day before `end`: one row of returns, items and
    return_rate. Both bounds reach the scans; a window in which nothing was sold has a null rate."""

    def inside(column: str) -> Column:
        low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (start, end))
        return (F.col(column) >= low) & (F.col(column) < high)

    returned = returns.where(inside("return_date")).agg(F.count("*").alias("returns"), F.lit(0).cast("long").alias("items"))
    sold = order_items.join(orders.where(inside("order_date")).select("order_id"), "order_id")
    sold = sold.agg(F.lit(0).cast("long").alias("returns"), F.count("*").alias("items"))
    both = returned.union(sold).agg(F.sum("returns").alias("returns"), F.sum("items").alias("items"))
    return both.withColumn("return_rate", F.try_divide(F.col("returns"), F.col("items")))


def kpi_return_rate_rolling(
    returns: DataFrame, order_items: DataFrame, orders: DataFrame, days: Sequence[int] = ROLLING_DAYS
) -> DataFrame:
    """Returns per item sold over trailing windows: day, window_days, returns, items, return_rate.

    There is a row for every window length and every day from the first event to the last, days
    without events included; a window is the day and the `days - 1` before it. Returns count on
    their `return_date`, items on their order's `order_date`; undated ones do not count. A window in
    which nothing was sold has a null rate. Without events there are no rows.

    Both streams are folded to one row a day before anything else moves. A day's counts are then dealt
    to the windows that hold it, and windows are added up by day, so no task sorts the calendar.
    """
    if not days or min(days) < 1:
        raise ValueError("a window has one day at least")
    zero = F.lit(0).cast("long")
    returned = returns.groupBy(F.to_date("return_date").alias("day")).agg(F.count("*").alias("returns"))
    sold = _items_by_day(order_items, orders)
    events = returned.withColumn("items", zero).unionByName(sold.withColumn("returns", zero)).where("day is not null")
    daily = events.groupBy("day").agg(F.sum("returns").alias("returns"), F.sum("items").alias("items"))

    lengths = F.explode(F.array(*[F.lit(int(n)) for n in days]))
    ends = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = ends.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    spine = calendar.select("day", lengths.alias("window_days"), zero.alias("returns"), zero.alias("items"), F.lit(True).alias("listed"))
    held = daily.select("day", lengths.alias("window_days"), "returns", "items")
    until = F.sequence(F.col("day"), F.date_add("day", F.col("window_days") - 1))
    dealt = held.select(F.explode(until).alias("day"), "window_days", "returns", "items", F.lit(False).alias("listed"))
    sums = [F.sum("returns").alias("returns"), F.sum("items").alias("items"), F.max("listed").alias("listed")]
    rolling = spine.unionByName(dealt).groupBy("day", "window_days").agg(*sums).where("listed").drop("listed")
    return rolling.withColumn("return_rate", F.try_divide(F.col("returns"), F.col("items")))


def kpi_headline(returns: DataFrame) -> DataFrame:
    """Fraud rate, recovery rate, net return cost and cycle time over all returns, one row.

    Cycle time covers returns with a disposition only; a return with any null amount adds
    nothing to net cost.
    """
    net = F.col("refund_amount") + F.col("processing_cost") - F.col("recovered_value")
    disposed = F.when(F.col("disposition").isNotNull(), F.col("cycle_time_hours"))
    return returns.agg(
        F.try_divide(flagged_count(), F.count("*")).alias("fraud_rate"),
        F.try_divide(F.sum("recovered_value"), F.sum("refund_amount")).alias("recovery_rate"),
        F.sum(net).alias("net_return_cost"),
        F.avg(disposed).alias("cycle_time_hours"),
    )


# View name -> builder over anything with `.table(name)`.
VIEWS = {
    "v_monthly_return_metrics": lambda w: monthly_return_metrics(w.table("returns")),
    "v_return_reasons_by_category": lambda w: return_reasons_by_category(
        w.table("returns"), w.table("order_items"), w.table("products")
    ),
    "v_disposition_outcomes": lambda w: disposition_outcomes(
        w.table("returns"), w.table("order_items"), w.table("products")
    ),
    "v_customer_return_summary": lambda w: customer_return_summary(w.table("customers"), w.table("returns")),
    "v_high_risk_returns": lambda w: high_risk_returns(w.table("returns"), w.table("customers")),
}
