"""Trailing return counts per customer.

For a return at instant t the count covers the customer's returns in [t - days, t). Instead of
a sliding frame (each row re-reads its whole frame) or a range self-join, it is the difference of
two running counts, of the returns before t and of those before t - days. Both frames only grow, so
they cost one shuffle and one sort together, however dense a customer's returns are.

Timelines of up to HOT returns take one shuffle and one window. A customer may also hold a third
of all returns; such timelines are cut into ten-minute slices (`_by_slice`), so that no task holds one
whole; the counts are the same either way. At most one customer per HOT returns is hot, which bounds the broadcast that tells the two
apart: a million ids for a trillion returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import micros
from backhaul.functions.time import DAY_MICROS

HOT = 1_000_000
SLICE_MICROS = 600_000_000


def with_trailing_count(returns: DataFrame, days: int = 90, history: DataFrame | None = None) -> DataFrame:
    """Every return with its `trailing_returns`; 0 where customer or date is null.

    `history` holds the returns to count, by default the given ones.
    """
    return _with_trailing_count(returns, days, history, HOT)


def _with_trailing_count(returns: DataFrame, days: int, history: DataFrame | None, hot: int) -> DataFrame:
    known = F.col("customer_id").isNotNull() & F.col("return_date").isNotNull()
    at = micros(F.col("return_date")).alias("_at")
    rows = returns.where(known).select("*", at)
    asked = rows.select("customer_id", "_at")
    past = asked if history is None else history.where(known).select("customer_id", at)

    everything = past if history is None else past.unionByName(asked)
    sizes = everything.groupBy("customer_id").agg(F.count("*").alias("n"))
    hot_ids = F.broadcast(sizes.where(F.col("n") > hot).select("customer_id"))

    def split(df: DataFrame, how: str) -> DataFrame:
        return df.join(hot_ids, "customer_id", how)

    own = history is None
    few = _by_customer(split(rows, "left_anti"), split(past, "left_anti"), days, own)
    many = _by_slice(split(rows, "left_semi"), split(past, "left_semi"), days, own)
    unknown = returns.where(~known).withColumn("trailing_returns", F.lit(0).cast("bigint"))
    columns = [*returns.columns, "trailing_returns"]
    return few.select(columns).unionByName(many.select(columns)).unionByName(unknown.select(columns))


def _before(*keys: str) -> Column:
    """Sum of the steps before the current instant."""
    earlier = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_step").over(earlier), F.lit(0))


def _by_customer(rows: DataFrame, past: DataFrame, days: int, own: bool) -> DataFrame:
    """Counts from whole timelines. `own`: the rows are the past themselves."""
    timeline = rows.withColumns({"_step": F.lit(1 if own else 0), "_asked": F.lit(True)})
    if not own:
        seen = past.select("customer_id", "_at", F.lit(1).alias("_step"))
        timeline = timeline.unionByName(seen, allowMissingColumns=True)
    ordered = Window.partitionBy("customer_id").orderBy("_at")

    def before(offset: int) -> Column:
        frame = ordered.rangeBetween(Window.unboundedPreceding, -offset - 1)
        return F.coalesce(F.sum("_step").over(frame), F.lit(0))

    return timeline.withColumn("trailing_returns", before(0) - before(days * DAY_MICROS)).where("_asked")


def _by_slice(rows: DataFrame, past: DataFrame, days: int, own: bool) -> DataFrame:
    """Counts from timelines cut into slices, each opened with the sum of the slices before.

    Steps of one instant are summed before the shuffle. The calendar then bounds both windows,
    whatever the number of returns: one sees at most the microseconds of ten minutes, the other
    the slices of one customer's history. The counts, one per instant, are joined back to the rows
    on an even key; AQE splits an instant that holds very many rows.
    """
    def events(df: DataFrame, *kinds: tuple[Column, int, int]) -> DataFrame:
        structs = [
            F.struct(at.alias("_at"), F.lit(step).alias("step"), F.lit(asks).alias("asks"))
            for at, step, asks in kinds
        ]
        return df.select("customer_id", F.inline(F.array(*structs)))

    enters, leaves = F.col("_at"), F.col("_at") + days * DAY_MICROS
    if own:
        timeline = events(past, (enters, 1, 1), (leaves, -1, 0))
    else:
        timeline = events(past, (enters, 1, 0), (leaves, -1, 0)).unionByName(events(rows, (enters, 0, 1)))
    slice_ = (F.col("_at") - F.pmod("_at", F.lit(SLICE_MICROS))).alias("_slice")
    steps = timeline.groupBy("customer_id", slice_, "_at").agg(
        F.sum("step").alias("_step"), F.max("asks").alias("_asks")
    )
    earlier = (
        Window.partitionBy("customer_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    opening = (
        steps.groupBy("customer_id", "_slice")
        .agg(F.sum("_step").alias("change"), F.max("_asks").alias("asks"))
        .withColumn("_step", F.sum("change").over(earlier))
        .where("asks > 0 and _step <> 0")
        .select("customer_id", "_slice", (F.col("_slice") - 1).alias("_at"), "_step", F.lit(0).alias("_asks"))
    )
    counts = (
        steps.unionByName(opening)
        .withColumn("trailing_returns", _before("customer_id", "_slice"))
        .where("_asks > 0")
        .select("customer_id", "_at", "trailing_returns")
    )
    return rows.join(counts, ["customer_id", "_at"], "left")
