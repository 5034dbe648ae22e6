"""Latest record per return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backhaul.sources.csv import SEQ


def dedupe_returns(df: DataFrame, seq: str = SEQ) -> DataFrame:
    """Keep the latest row per `return_id`; on equal dates the later ingested row wins.

    A null date counts as latest. The filter on the row number lets Spark drop all but one row
    per key before the shuffle, so a return repeated many times does not pile up in one task.
    """
    latest = Window.partitionBy("return_id").orderBy(
        F.col("return_date").desc_nulls_first(), F.col(seq).desc()
    )
    return df.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")
