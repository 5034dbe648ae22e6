"""Fraud signals: one row per (return, rule that fired).

A rule is data: a predicate, a severity, a score and the numbers behind them, all columns over
the signal input (see `backhaul.plans.signals.signal_input`). Rules given together are evaluated
in one pass over their input, without a scan or shuffle per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from backhaul.operators.trailing import with_trailing_count

# Thresholds, scores and version tag.
SERIAL_THRESHOLD = 5
SERIAL_WINDOW_DAYS = 90
WARDROBING_MIN_DAYS = 1
WARDROBING_MAX_DAYS = 3
WARDROBING_REASONS = ("changed_mind", "not_as_described")
WARDROBING_SCORE = 0.85
NIGHT_START_HOUR = 23
NIGHT_END_HOUR = 4
NIGHT_SCORE = 0.35
MISMATCH_SCORE = 0.95
MODEL_VERSION = "rules_v1"

SIGNAL_SCHEMA = StructType(
    [
        StructField("return_id", LongType()),
        StructField("signal_type", StringType()),
        StructField("severity", StringType()),
        StructField("score", DoubleType()),
        StructField("evidence", StringType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    signal_type: str
    needs: tuple[str, ...]
    fires: Column
    severity: Column
    score: Column
    evidence: Column

    def signal(self) -> Column:
        """The signal as a struct, null where the rule does not fire."""
        values = (
            F.col("return_id").cast("bigint"),
            F.lit(self.signal_type),
            self.severity,
            self.score.cast("double"),
            F.to_json(self.evidence),
        )
        named = [v.alias(name) for v, name in zip(values, SIGNAL_SCHEMA.fieldNames())]
        return F.when(self.fires, F.struct(*named))


def serial_returner() -> Rule:
    n = F.col("trailing_returns")
    return Rule(
        "serial_returner",
        needs=("trailing_returns",),
        fires=n > SERIAL_THRESHOLD,
        severity=F.when(n > 2 * SERIAL_THRESHOLD, "high").otherwise("medium"),
        score=F.least(F.lit(1.0), n / (3.0 * SERIAL_THRESHOLD)),
        evidence=F.struct(
            n.alias("returns_in_window"), F.lit(SERIAL_WINDOW_DAYS).alias("window_days")
        ),
    )


def wardrobing() -> Rule:
    days = F.col("days_since_purchase")
    return Rule(
        "wardrobing",
        needs=("days_since_purchase", "return_reason"),
        fires=days.between(WARDROBING_MIN_DAYS, WARDROBING_MAX_DAYS)
        & F.col("return_reason").isin(*WARDROBING_REASONS),
        severity=F.lit("high"),
        score=F.lit(WARDROBING_SCORE),
        evidence=F.struct(days.cast("int").alias("days_since_purchase")),
    )


def time_anomaly(skip_midnight: bool = False) -> Rule:
    """Off-hours returns by the stored wall-clock hour.

    Date-only timestamps read as hour 0 and fire; `skip_midnight` leaves exact midnights out.
    """
    ts = F.col("return_date")
    hour = F.hour(ts)
    fires = (hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR)
    if skip_midnight:
        fires &= ts != F.date_trunc("day", ts).cast("timestamp_ntz")
    return Rule(
        "time_anomaly",
        needs=("return_date",),
        fires=fires,
        severity=F.lit("low"),
        score=F.lit(NIGHT_SCORE),
        evidence=F.struct(ts.cast("string").alias("return_date")),
    )


def value_mismatch() -> Rule:
    refund, price = F.col("refund_amount"), F.col("unit_price")
    return Rule(
        "value_mismatch",
        needs=("refund_amount", "unit_price"),
        fires=refund > price,
        severity=F.lit("high"),
        score=F.lit(MISMATCH_SCORE),
        evidence=F.struct(
            refund.cast("double").alias("refund_amount"), price.cast("double").alias("unit_price")
        ),
    )


RULES = (serial_returner, wardrobing, time_anomaly, value_mismatch)


def detect(df: DataFrame, *rules: Rule) -> DataFrame:
    """Signals of the given rules; a rule whose columns are missing raises none."""
    usable = [r for r in rules if set(r.needs) <= set(df.columns)]
    if not usable:
        return df.sparkSession.createDataFrame([], SIGNAL_SCHEMA)
    fired = F.array_compact(F.array(*[r.signal() for r in usable]))
    return df.select(F.inline(fired))


def detect_serial_returners(returns: DataFrame, history: DataFrame | None = None) -> DataFrame:
    keys = returns.select("return_id", "customer_id", "return_date")
    return detect(with_trailing_count(keys, SERIAL_WINDOW_DAYS, history), serial_returner())


def detect_wardrobing(returns: DataFrame) -> DataFrame:
    return detect(returns, wardrobing())


def detect_late_night_returns(returns: DataFrame, skip_midnight: bool = False) -> DataFrame:
    return detect(returns, time_anomaly(skip_midnight))


def detect_value_mismatch(returns: DataFrame) -> DataFrame:
    return detect(returns, value_mismatch())


def tagged(signals: DataFrame) -> DataFrame:
    return signals.withColumn("model_version", F.lit(MODEL_VERSION))


def compute_all_signals(returns: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Signals of every rule over an enriched frame, tagged with the rule-set version."""
    rules = [build() for build in RULES] if rules is None else rules
    if any("trailing_returns" in r.needs for r in rules):
        returns = with_trailing_count(returns, SERIAL_WINDOW_DAYS)
    return tagged(detect(returns, *rules))
