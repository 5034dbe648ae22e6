from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backhaul.operators import with_position


def test_places_follow_the_order_over_many_partitions(spark):
    df = spark.range(0, 20_000, 1, 7).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 3).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = with_position(df, F.col("g").desc(), "k")
        assert len(placed.inputFiles()) > 1
        got = [tuple(r) for r in placed.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    keys = sorted(((k, g) for k, g, _ in got), key=lambda r: (-r[1], r[0]))
    assert sorted(got, key=lambda r: r[2]) == [(k, g, i) for i, (k, g) in enumerate(keys, 1)]


def test_one_value_nulls_and_nothing(spark):
    same = spark.range(50).select(F.lit(1).alias("v"), "id")
    assert [r.position for r in with_position(same, "v", "id").orderBy("id").collect()] == list(range(1, 51))
    odd = spark.createDataFrame([(None,), ("b",), ("a",)], "v string")
    assert sorted((r.position, r.v) for r in with_position(odd, F.col("v").asc_nulls_last()).collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert with_position(odd.limit(0), "v").count() == 0
    with pytest.raises(ValueError, match="position"):
        with_position(odd.withColumn("position", F.lit(1)), "v")


def test_rows_are_not_gathered(spark):
    df = with_position(spark.range(1000).withColumnRenamed("id", "k"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The one gathering exchange is that of the counts.
    assert plan.count("SinglePartition") == 1 and plan.index("SinglePartition") < plan.index("HashAggregate")
