"""Join helper for skewed many-to-one joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join `rows` to an aggregate that holds one row per `key`.

    Spark would reuse the aggregate's own partitioning for such a join, and AQE cannot split a
    hot key in that case. A second join key, computed from the first, makes both sides shuffle
    for this join, so AQE can split the row side or broadcast the aggregate if it turns out
    small. The extra shuffle moves one row per key. One bit is enough, and takes no room in a
    shuffle, which a whole hash, not to be compressed, does in every row.
    """
    guard = F.pmod(F.xxhash64(key), F.lit(2)).alias("_guard")
    return (
        rows.select("*", guard).join(per_key.select("*", guard), [key, "_guard"], how).drop("_guard")
    )
