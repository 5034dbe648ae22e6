"""Row numbers in a stated order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.session import written

_INDEX = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Every row with its place, from 1, in the given order, which must tell all rows apart.

    Rows are range partitioned and sorted, and written with their place in their partition, so that
    places are settled once. Rows are then counted per partition; the running total of these counts,
    one number per partition, is what rows before a partition number, and goes to all tasks. An
    empty frame stays empty.
    """
    if name in df.columns:
        raise ValueError(f"there is a column named {name} already")
    part, at = f"{name}_part", f"{name}_at"
    index = F.monotonically_increasing_id().bitwiseAND(_INDEX)
    placed = written(df.orderBy(*order).select("*", F.spark_partition_id().alias(part), index.alias(at)), "positions")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    numbered = placed.join(F.broadcast(before), part)
    return numbered.select(*df.columns, (F.col("n_before") + F.col(at) + 1).alias(name))
